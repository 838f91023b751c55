"""Minimum cuts against all labellings, and pages with every kind of boilerplate."""

import html
import itertools
import random
import re
import time

import pytest

from leafloom.llm import html_extract as hx

PROSE = "The council met on Tuesday to talk about the new bridge, which had been closed since the spring floods."


def cut_cost(labels, parent, weight, evidence):
    return sum(abs(e) for x, e in zip(labels, evidence) if x != (e > 0)) + sum(w for v, (p, w) in enumerate(zip(parent, weight)) if v and labels[v] != labels[p])


def max_flow(parent, weight, evidence):
    """The most that flows from the source to the sink, by augmenting paths over the whole graph."""
    n = len(parent)
    room = [[0.0] * (n + 2) for _ in range(n + 2)]
    for v in range(n):
        if v:
            room[v][parent[v]] = room[parent[v]][v] = weight[v]
        room[n][v], room[v][n + 1] = max(evidence[v], 0.0), max(-evidence[v], 0.0)
    total = 0.0
    while True:
        came, queue = {n: n}, [n]
        for u in queue:
            for v in range(n + 2):
                if room[u][v] > 1e-9 and v not in came:
                    came[v] = u
                    queue.append(v)
        if n + 1 not in came:
            return total
        path, v = [], n + 1
        while v != n:
            path.append((came[v], v))
            v = came[v]
        least = min(room[u][v] for u, v in path)
        for u, v in path:
            room[u][v] -= least
            room[v][u] += least
        total += least


def test_min_cut_is_a_minimum_and_equals_the_maximum_flow():
    rnd = random.Random(6)
    for _ in range(300):
        n = rnd.randrange(1, 9)
        evidence = [rnd.uniform(-2, 2) for _ in range(n)]
        parent, weight = [-1] + [rnd.randrange(v) for v in range(1, n)], [rnd.uniform(0, 1.5) for _ in range(n)]
        best = min(cut_cost(x, parent, weight, evidence) for x in itertools.product([False, True], repeat=n))
        assert cut_cost(hx.min_cut(parent, weight, evidence), parent, weight, evidence) == pytest.approx(best)
        assert max_flow(parent, weight, evidence) == pytest.approx(best)


def test_tree_of_a_page():
    """Neighbours under one element are places after each other; an element hangs at its place."""
    tree = hx.read_page("<div>a<p>b</p></div>c")
    nodes = {text: node for node, text, _, _ in tree.blocks}
    up = lambda v, k: v if k == 0 else up(tree.parent[v], k - 1)
    div = up(nodes["a"], 1)
    assert up(div, 1) == 0 and up(nodes["b"], 3) == div and up(nodes["c"], 2) == 0
    assert all(p < v for v, p in enumerate(tree.parent))


PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head>
<body class="has-sidebar"><header class="site-header"><a href="/">Home</a> Site name</header>
<nav><ul><li><a href="/a">First</a></li><li><a href="/b">Second</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site better. Please accept them, thank you.</div>
<main><article class="post"><header><h1>A bridge &amp; a river</h1></header><p>{PROSE}</p>
<div class="ad">Buy two bridges and get a third one for free, only this week and only here.</div>
<p>Short one<br>here.</p><p><b>Bold&nbsp;start {PROSE}<form><label>Email</label><input><button>Send</button> Sign up for letters</form>
<p>{PROSE} &lt;end&gt;</p></article>
<section id="comments"><h2>Comments</h2><article class="comment"><p>I think this is a very good article about a bridge, thank you for it.</p></article></section></main>
<aside class="sidebar"><h3>Most read</h3><p>{PROSE}</p></aside>
<footer>&copy; 2024 Site. All rights reserved.</footer><noscript>Turn on scripts</noscript></body></html>"""


def test_page_with_every_kind_of_boilerplate():
    assert hx.main_text(PAGE) == f"A bridge & a river {PROSE} Short one here. Bold start {PROSE} {PROSE} <end>"


def test_page_without_article_element():
    body = "".join(f"<p>{PROSE}</p>" for _ in range(3))
    page = f'<div id="menu"><a href=1>One</a> <a href=2>Two</a></div><div class="box">{body}<p>Yes.</p>{body}</div><div id="footer"><a href=3>Terms</a></div>'
    assert hx.main_text(page) == " ".join([PROSE] * 3 + ["Yes."] + [PROSE] * 3)


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div><p>{PROSE}</p><p>Yes</p><p>{PROSE}</p></div>", f"{PROSE} Yes {PROSE}"),  # a word between paragraphs
        (f"<div><p>{PROSE}</p><ul><li>salt</li><li>two eggs</li></ul><p>{PROSE}</p></div>", f"{PROSE} salt two eggs {PROSE}"),  # a list in the text
        (f"<div><h2>Notes</h2><p>{PROSE}</p></div>", f"Notes {PROSE}"),
        ("<div><div>salt</div><div>two eggs</div></div>", ""),  # the same words with nothing around them
        (f"<div><p>{PROSE}</p><table><tr><td>A</td><td>12</td></tr></table><p>{PROSE}</p></div>", f"{PROSE} A 12 {PROSE}"),
    ],
)
def test_the_cut_decides_what_the_classifier_leaves_open(page, want):
    blocks = hx.label_blocks(page)
    assert hx.main_text(page) == want
    assert not want or any(keep and odds < 0 for _, odds, keep in blocks)


def test_the_cut_changes_labels_of_given_pages():
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    blocks = [b for r in rows for b in hx.label_blocks(r["html"] or "")]
    assert sum((odds > 0) != keep for _, odds, keep in blocks) >= 50
    assert all(hx.main_text(r["html"]) == expected(r["html"]) for r in rows)


def test_long_and_deep_pages_take_linear_time():
    began = time.process_time()
    assert hx.main_text("<article>" + f"<p>{PROSE}</p><p>x</p>" * 25_000 + "</article>").count(" x") == 25_000
    assert hx.main_text("<div>" * 12_000 + f"<p>{PROSE}</p>") == PROSE
    hx.main_text("<blockquote>" * 20_000 + "</p></li>" * 20_000 + "<p>" * 20_000 + "x")
    assert time.process_time() - began < 20


@pytest.mark.parametrize(
    "part",
    [
        '<video-player src="a.mp4"></video-player>',
        "<audio-player>\n</audio-player>",
        "<button-group></button-group>",
        "<object-card/>",
        "<SVG-icon name=x></SVG-icon>",
        "<title-bar></title-bar>",
        '<svg class="icon" viewBox="0 0 1 1"/>',
        "<svg/>",
        "<math />",
        '<svg data-path="a>b" width=\'1\' />',
        "<svg viewBox=0/0 ><path d='M0 0'/>no</svg>",
        "<svg width=10/>no</svg>",
        "<svg>no<path d='M0 0'/>no</svg>",
        "<video src=a.mp4>no</video>",
        "<video\nsrc=a.mp4>no</video>",
        "<canvas/>no</canvas>",
    ],
)
def test_raw_elements_end_where_they_should(part):
    assert hx.main_text(f"<article><p>{PROSE}</p>{part}<p>{PROSE}</p><p>{PROSE}</p></article>") == " ".join([PROSE] * 3)


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<p>" * 5000, "<b>" * 5000, "&" * 5000, "<a '" * 2000, "a<b>c</b>d " * 20000])
def test_odd_pages_do_not_fail(page):
    assert isinstance(hx.main_text(page), str)


def expected(page):
    m = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1].replace("<br>", " ")) if m else []
    plain = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in parts)
    return " ".join(x for x in plain if x)


def test_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id bigint, url string, html string")
    every = pages.unionByName(odd).selectExpr("*", "1 AS text", "'x' AS n_chars", "2 AS id")
    rows = [(r.page_id, r.url, expected(r.html), len(expected(r.html))) for r in every.collect()]
    assert sorted(map(tuple, hx.extract_main_text(every).collect()), key=repr) == sorted(rows, key=repr)
    assert hx.extract_main_text(pages.limit(0)).collect() == []


STORY = "".join(f"<p>Paragraph {i} tells what happened on that day in the old town, and who was there to see it all.</p>" for i in range(6))


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="share-price-story">{STORY}</div></body>',
        f'<body><article class="related-research">{STORY}</article></body>',
        f'<body><aside class="sidebar"><a href=x>Links</a></aside><div class="banner side">{STORY}</div></body>',
        f'<body><article>{STORY}</article><div class="kommentare"><p>Das ist ein langer Kommentar einer Leserin, der hier nicht hingehört.</p></div></body>',
        f'<body><article>{STORY}</article><div class="rail"><p>Buy the best shoes in town today, for half the price of last week.</p></div></body>',
        f'<body><article>{STORY}</article><div><p>We use cookies to improve your visit; please accept them or change your preferences.</p></div></body>',
        f'<body><div id="comments-layout"><article>{STORY}</article></div></body>',
        f'<body><div class="post">{STORY}</div><section class="commentaires">{STORY * 3}</section></body>',
    ],
)
def test_names_are_judged_by_what_elements_hold(page):
    want = " ".join(re.findall(r"<p>(.*?)</p>", STORY))
    assert hx.main_text(page) == want


def test_a_page_without_markup_is_one_block():
    assert hx.main_text("hello   world") == "hello world"
    assert hx.main_text("a &amp; b") == "a & b"
    assert hx.main_text(" ") == ""


def test_consent_in_an_article_stays():
    page = f"<article>{STORY}<p>The law on cookies asks that readers accept them before anything is stored on their machine.</p></article>"
    assert "law on cookies" in hx.main_text(page)
