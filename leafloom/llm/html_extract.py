"""Main text of web pages by minimum-cut labelling.

A page is read as a tree: elements, and text blocks as leaves. A linear classifier over a block's text
and the elements around it gives the log odds of being content: the capacity of the block's edge to
one of the two terminals. Smoothness edges run between an element and what it holds (DOM proximity)
and between neighbours under one element (adjacency), so the graph without terminals is a tree. The
minimum cut leaves the blocks of the article on the source side.

Names of elements are evidence, not verdicts: but for those of comments, adverts and consent, they count only
where the element doesn't hold the page's prose itself.

Terminal and smoothness capacities are on one scale: evidence up to ``LEAF`` is overruled by what
stands around a block, stronger evidence is not. So a one-word paragraph between paragraphs is
content, and so is an item of a list in an article, but not a link of a menu.

On a tree a maximum flow takes one pass: from the leaves up, each node hands on what it has left over,
as far as its edge goes; then sides are read off from the root down. Time and memory are linear in
the page, however deep or long it is. Pages are read in place, and nothing is shuffled.
"""

from __future__ import annotations

import html as markup
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that part text into blocks, and those whose content is never text of a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
SILENT_TAGS = "script style noscript template svg math iframe object canvas audio video select textarea button title".split()
VOID_TAGS = frozenset("hr".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head",)}

# Words of class, id and role that tell what an element holds, in English, German, French,
# Spanish, Italian and Portuguese. What readers, advertisers and consent managers write is prose, too, so
# their names count wherever they stand, unless the element holds the article. All other names are judged by
# what the element holds: they don't count for one that has the page's prose in it.
STRONG_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsored sponsor werbung anzeige anzeigen publicite publicidad pubblicita publicidade anuncio anuncios "
    "comment comments commentlist disqus kommentar kommentare commentaire commentaires comentario comentarios commenti comentarios "
    "cookie cookies consent gdpr dsgvo rgpd".split()
)
JUDGED_WORDS = frozenset(
    "respond reply replies newsletter subscribe signup popup modal promo promotion related recommended breadcrumb breadcrumbs pagination pager share sharing social skip "
    "teilen verwandt verwandte empfohlen partager similaires compartir relacionados condividi correlati compartilhar".split()
)
WEAK_WORDS = frozenset(
    "nav navbar navigation menu sidebar aside side footer header masthead banner notice alert overlay login search widget toolbar "
    "copyright legal disclaimer complementary contentinfo topbar bottombar rail "
    "seitenleiste fusszeile kopfzeile hinweis suche impressum navigazione navegacion navegacao barre pied entete barra pie cabecera rodape".split()
)
GOOD_WORDS = frozenset("article content post entry story main body text page artikel beitrag inhalt contenu texte articulo contenido texto articolo contenuto testo artigo conteudo".split())
# Words of consent notices.
CONSENT_WORDS = re.compile(r"\bcookies?\b", re.I)
CONSENT_ACTS = re.compile(r"\b(?:accept|agree|consent|preferences|privacy|akzeptier|einverstanden|zustimm|datenschutz|accepte[rz]?|confidentialit|acepta|privacidad|accett|aceita)", re.I)
BAD_TAGS = frozenset("nav aside footer form dialog menu".split())

#: Weights of the classifier, in log odds of being content. What a text says by itself ends at TEXT_MOST.
BIAS, WORDS, TEXT_MOST, PROSE, LINKS, HEADING = -1.7, 0.9, 3.5, 1.2, -5.0, 1.0
IN_ARTICLE, GOOD, STRONG, WEAK, BAD_TAG, HEADER, CONSENT = 0.4, 0.5, -8.5, -7.5, -7.5, -7.0, -7.0
#: A block is prose from so many words on if less than that share of it is links; an element has the page's
#: prose if so much of it is in there, and that is a paragraph at least.
PROSE_WORDS, PROSE_LINKS, PRINCIPAL, PARAGRAPH = 8, 0.3, 0.4, 120
#: What an article element says for itself: all of it is content or none, unless blocks in it say otherwise.
ARTICLE = 4.0
#: Capacities of the smoothness edges, in the same unit: a block to its place, a place to the next one
#: under the same element, an element to its place (parts of lists and tables hold together more).
LEAF, STEP, ELEMENT, PART = 2.5, 5.0, 2.5, 5.0
PART_TAGS = frozenset("li ul ol dl dt dd tr td th tbody thead tfoot table blockquote figure pre p".split())

_SILENT = "|".join(SILENT_TAGS)
# A name ends at white space, "/" or ">": <video-player> is no <video>. Only svg and math can close
# themselves; a slash that ends an unquoted value doesn't do that.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/>])(?:[^>=/]|/(?!>)|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?)*+/>"
    rf"|<(?P<raw>{_SILENT})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    """An open element: what its tag and names say about the text in it."""

    __slots__ = ("tag", "names", "up", "wraps", "tail", "empty", "says", "article", "at", "prose")

    def __init__(self, tag: str, rest: str, up: Element | None, node: int):
        self.tag, self.up, self.wraps, self.tail, self.empty = tag, up, False, node, True
        self.says, self.article, self.at, self.prose = 0.0, False, node, 0
        self.names: frozenset[str] = frozenset()
        if "=" in rest:
            self.names = frozenset(p.lower() for m in _NAMES.finditer(rest) for p in _PARTS.findall(m[1] or m[2] or m[3] or ""))


class Page:
    """The tree of a page. Node 0 is the page; ``parent`` and ``weight`` name each other node's edge
    upwards, and parents come before their children. ``blocks`` has (node, text, element, share of
    the text that is in links)."""

    def __init__(self):
        self.parent, self.weight = [-1], [0.0]
        self.top = Element("", "", None, 0)
        self.elements: list[Element] = [self.top]
        self.blocks: list[tuple[int, str, Element, float]] = []

    def node(self, parent: int, weight: float) -> int:
        self.parent.append(parent)
        self.weight.append(weight)
        return len(self.parent) - 1

    def place(self, under: Element, weight: float) -> int:
        """A node at the next place under an element."""
        if not under.empty:
            under.tail = self.node(under.tail, STEP)
        under.empty = False
        return self.node(under.tail, weight)


def read_page(page: str) -> Page:
    """The blocks of a page in order, each with decoded text in which white space is one space. Broken
    markup is read as a browser would: paragraphs and items end each other, stray end tags are ignored."""
    tree = Page()
    stack = [tree.top]
    held: Counter[str] = Counter()  # tags on the stack
    parts: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(markup.unescape("".join(parts)).split())
            if text:
                tree.blocks.append((tree.place(stack[-1], LEAF), text, stack[-1], min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        held.subtract(e.tag for e in stack[k:])
        del stack[k:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m["end"] or m["end2"])
        if tag not in BLOCK_TAGS:
            if tag == "a":
                in_link = not closing
            elif tag == "br" or tag == "img":
                parts.append(" ")
            continue
        flush()
        in_link = False
        if closing:
            if held[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        ends = (*CLOSES.get(tag, ()), *(("p",) if tag not in ("body", "html") else ()))
        if any(held[x] for x in ends):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    close(k)
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "div", "article", "section", "body"):
                    break
        if tag in VOID_TAGS:
            continue
        up = stack[-1]
        element = Element(tag, m["rest"] or m["rest2"] or "", up, tree.place(up, PART if tag in PART_TAGS else ELEMENT))
        if tag in ("article", "main") or "main" in element.names and "content" in element.names:
            e = up
            while e is not None and not e.wraps:
                e.wraps = True
                e = e.up
        stack.append(element)
        held[tag] += 1
        tree.elements.append(element)
    parts.append(page[at:])
    flush()
    return tree


def count_prose(page: Page) -> None:
    """``prose``: the characters of prose in each element."""
    for _, text, element, links in page.blocks:
        if text.count(" ") + 1 >= PROSE_WORDS and links < PROSE_LINKS:
            element.prose += len(text)
    for e in reversed(page.elements[1:]):
        e.up.prose += e.prose


def weigh_elements(elements: list[Element]) -> None:
    """``says``: what an element and those around it add to the log odds of the text in it."""
    least = max(PARAGRAPH, PRINCIPAL * elements[0].prose)
    for e in elements[1:]:
        x, e.article = e.up.says, e.up.article
        principal = e.prose >= least
        if e.tag not in ("html", "body"):
            if e.names & STRONG_WORDS and not (principal and e.wraps) or e.names & JUDGED_WORDS and not principal or e.tag == "head":
                x += STRONG
            if e.tag in ("article", "main") and not e.article:
                e.article = True
                x += IN_ARTICLE
            if not e.wraps:
                if e.tag in BAD_TAGS and not principal:
                    x += BAD_TAG
                if not e.article and e.tag == "header" and not principal:
                    x += HEADER
                if e.names & WEAK_WORDS and not principal and not (e.article and e.names & WEAK_WORDS == {"header"}):
                    x += WEAK
            if e.names & GOOD_WORDS and not e.names & WEAK_WORDS:
                x = min(x + GOOD, 1.0) if x <= 1.0 else x
            if e.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                x += HEADING
        e.says = max(x, 2 * STRONG)


def content_score(text: str, element: Element, links: float) -> float:
    """Log odds that a block is content, from its text and what is around it."""
    x = BIAS + min(WORDS * math.log(text.count(" ") + 1), TEXT_MOST) + LINKS * links
    if text[-1] in ".!?…:;\"'”’)":
        x += PROSE
    if not element.article and CONSENT_WORDS.search(text) and CONSENT_ACTS.search(text):
        x += CONSENT
    return x + element.says


def min_cut(parent: list[int], weight: list[float], evidence: list[float]) -> list[bool]:
    """The sides of a minimum cut of a tree with terminals: parents come before their children,
    ``weight`` is the capacity of each node's edge upwards, and positive evidence is the capacity from
    the source (True), negative that to the sink. Of several minima the one with the fewest nodes on
    the source side."""
    left = list(evidence)
    for v in range(len(parent) - 1, 0, -1):
        left[parent[v]] += max(-weight[v], min(weight[v], left[v]))
    side = [left[0] > 0] if left else []
    for v in range(1, len(parent)):
        side.append(left[v] + (weight[v] if side[parent[v]] else -weight[v]) > 0)
    return side


def label_blocks(page: str) -> list[tuple[str, float, bool]]:
    """(text, log odds, whether the cut leaves it with the content) of each block of a page."""
    tree = read_page(page)
    if len(tree.elements) == 1:  # no element parts the text, so it is all there is
        return [(text, ARTICLE, True) for _, text, _, _ in tree.blocks]
    count_prose(tree)
    weigh_elements(tree.elements)
    evidence = [0.0] * len(tree.parent)
    for e in tree.elements:
        if e.article and not e.up.article:
            evidence[e.at] = ARTICLE if e.says > 0 else 0.0
    for node, text, element, links in tree.blocks:
        evidence[node] = content_score(text, element, links)
    side = min_cut(tree.parent, tree.weight, evidence)
    return [(text, evidence[node], side[node]) for node, text, _, _ in tree.blocks]


def main_text(page: str | None) -> str:
    """The text of the page's content blocks, joined by one space; empty if there are none."""
    return " ".join(text for text, _, keep in label_blocks(page or "") if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"]
        )


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, ``text`` and ``n_chars`` (its code points).

    Defined cases: a null or empty page has an empty text; text without any markup is one block;
    null and repeated ids are rows of their own; an empty table gives an empty table. Other columns
    aren't read.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    schema = f"id {dict(own.dtypes)['id']}, url string, text string, n_chars bigint"
    return own.mapInArrow(_extract, schema).withColumnsRenamed({"id": id_col, "url": url_col})
