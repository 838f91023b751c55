"""Queries over documents and their pages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafloom.functions.text import SPACE
from leafloom.operators import pages as ops
from leafloom.plans import REGISTRY
from leafloom.plans.sql import PAGES, REGIONS, WORDS, norm, tokens
from leafloom.sources.derived import doc_pages, regions, table, together, words


@REGISTRY.add("normalize_pages", f"SELECT doc_id, {norm('text')} AS text FROM documents")
def normalize_pages(spark, sf_dir):
    return ops.normalize_pages(table(spark, sf_dir, "documents").select("doc_id", "text"), nfkc=True)


@REGISTRY.add("tokenize_pages", f"WITH {PAGES} SELECT doc_id, page_no, len({tokens(norm('text'))}) AS word_count, array_to_string({tokens(norm('text'))}, ' ') AS tokens FROM pages_")
def tokenize_pages(spark, sf_dir):
    return ops.tokenize_pages(doc_pages(spark, sf_dir))


#: What is planted behind the pages, by page_id modulo their number: markup, what is left of it, and the tags,
#: attributes and links that go.
PLANTED = [
    ("<p>plain</p>", "<p>plain</p>", 0, 0, 0),
    ("<scr<meta>ipt>alert(1)</script>", "ipt>alert(1)", 1, 0, 0),
    ('<a href="x"onclick=alert(1)>y</a>', '<a href="x">y</a>', 0, 1, 0),
    ('<a href="&#106;avascript:alert(1)">y</a>', "<a>y</a>", 0, 0, 1),
    ('<a href="java\nscript:alert(1)">y</a>', "<a>y</a>", 0, 0, 1),
    ("<p>There is only = one way, once = two, data-set = 5</p>", "<p>There is only = one way, once = two, data-set = 5</p>", 0, 0, 0),
    ("<form><p>keep this text</p></form>", "<p>keep this text</p>", 1, 0, 0),
    ("<svg><script>x</script><a href=y>z</a></svg><p data-k='1' title='a\"b'>q</p>", '<p title="a&quot;b">q</p>', 1, 1, 0),
    ("<iframe srcdoc='<p>no</p>'></iframe>1 < 2<img src=x onerror=y>", '1 &lt; 2<img src="x">', 1, 1, 0),
]


def planted_pages(spark, sf_dir):
    more = F.array(*(F.lit(p[0]) for p in PLANTED))
    return table(spark, sf_dir, "pages").withColumn("html", F.concat("html", F.get(more, (F.col("page_id") % len(PLANTED)).cast("int"))))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_REST = ", ".join(f"({k}, {_quoted(p[1])}, {p[2]}, {p[3]}, {p[4]})" for k, p in enumerate(PLANTED))


@REGISTRY.add(
    "sanitize_html",
    f"""WITH rest_(k, html, tags, attributes, links) AS (VALUES {_REST})
    SELECT page_id, len(regexp_extract_all(p.html, '<(script|meta)[ >]')) + tags AS tags, attributes::BIGINT AS attributes, links::BIGINT AS links,
    regexp_replace(p.html, '(?s)<script>.*?</script>|<meta[^>]*>|<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g') || r.html AS clean FROM pages p JOIN rest_ r ON k = page_id % {len(PLANTED)}""",
)
def sanitize_html(spark, sf_dir):
    """Pages, each with a piece of active or harmless markup behind it."""
    return ops.sanitize_html(planted_pages(spark, sf_dir))


def holes(pages):
    """Pages of which every seventeenth by number and document has no text at all."""
    return pages.withColumn("text", F.when((F.col("doc_id") + 3 * F.col("page_no")) % 17 != 0, F.col("text")))


HOLES = f"{PAGES}, holes_ AS (SELECT * REPLACE (CASE WHEN (doc_id + 3 * page_no) % 17 <> 0 THEN text END AS text) FROM pages_)"


@REGISTRY.add(
    "pages_needing_ocr",
    rf"""WITH {HOLES}, n_ AS (SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE length(regexp_replace(text, '\s', '', 'g')) END AS n FROM holes_)
    SELECT doc_id, count(*) FILTER (n < 24) AS to_recognise, count(*) FILTER (n >= 24) AS skipped FROM n_ GROUP BY 1""",
)
def pages_needing_ocr(spark, sf_dir):
    return ops.pages_needing_ocr(holes(doc_pages(spark, sf_dir)))


BLANKED = f"""{PAGES}, ink_ AS (SELECT doc_id, page_no, CASE WHEN (doc_id + page_no) % 26 = 0 THEN NULL WHEN (doc_id + page_no) % 13 = 0 THEN '' ELSE text END AS text,
  CASE WHEN (doc_id + page_no) % 39 = 0 THEN NULL WHEN (doc_id + page_no) % 13 = 0 THEN 0.0 ELSE len(regexp_extract_all(text, '[A-Za-z]')) / greatest(length(text), 1)::DOUBLE END AS ink FROM pages_)"""


def blanked(spark, sf_dir):
    """Every thirteenth page is blank, of which some have no text or no ink that was measured."""
    n = F.col("doc_id") + F.col("page_no")
    blank = n % 13 == 0
    ink = F.when(n % 39 == 0, None).when(blank, 0.0).otherwise(F.regexp_count("text", F.lit("[A-Za-z]")) / F.greatest(F.length("text"), F.lit(1)))
    return doc_pages(spark, sf_dir).withColumn("ink", ink).withColumn("text", F.when(n % 26 == 0, None).when(blank, "").otherwise(F.col("text")))


@REGISTRY.add(
    "remove_blank_pages",
    f"""WITH {BLANKED}, m_ AS (SELECT *, length(trim(coalesce(text, ''))) = 0 AND coalesce(ink, 0) < 0.00135 AS blank FROM ink_),
    e_ AS (SELECT *, bool_and(blank) OVER (PARTITION BY doc_id) AS error FROM m_)
    SELECT doc_id, page_no, text, ink::DOUBLE AS ink, error, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS new_no FROM e_ WHERE error OR NOT blank""",
)
def remove_blank_pages(spark, sf_dir):
    return ops.remove_blank_pages(blanked(spark, sf_dir))


@REGISTRY.add("scrub_metadata", "SELECT doc_id, lang AS kept, 1 AS n_keys, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def scrub_metadata(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("meta", F.create_map(F.lit("source"), "source", F.lit("lang"), "lang"))
    out = ops.scrub_metadata(docs, keep=("lang",))
    return out.select("doc_id", F.col("meta")["lang"].alias("kept"), F.size("meta").alias("n_keys"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@REGISTRY.add(
    "apply_page_plan",
    f"""WITH {PAGES}, plan_ AS (SELECT doc_id, n - page_no AS ord, page_no - 1 + CASE WHEN page_no % 6 = 0 THEN 2 ELSE 0 END AS source_index, page_no * 90 AS rotation
      FROM (SELECT *, max(page_no) OVER (PARTITION BY doc_id) AS n FROM pages_))
    SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY ord) AS page_no, source_index, ((g.page_no % 4) * 90 + rotation) % 360 AS rotation, text
    FROM plan_ p JOIN pages_ g ON p.doc_id = g.doc_id AND source_index + 1 = g.page_no""",
)
def apply_page_plan(spark, sf_dir):
    """Pages in reverse; every sixth item asks for a page two further on."""
    pages = doc_pages(spark, sf_dir).withColumn("rotation", F.col("page_no") % 4 * 90)
    from pyspark.sql import Window as W

    n = F.max("page_no").over(W.partitionBy("doc_id"))
    plan = pages.select("doc_id", (n - F.col("page_no")).alias("ord"), (F.col("page_no") - 1 + F.when(F.col("page_no") % 6 == 0, 2).otherwise(0)).alias("source_index"), (F.col("page_no") * 90).alias("rotation"))
    return ops.apply_page_plan(pages, plan)


@REGISTRY.add(
    "sentence_paragraphs",
    r"""WITH s_ AS (SELECT doc_id, string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ps FROM documents)
    SELECT doc_id, unnest(range(1, len(ps) + 1)) AS par_no, unnest(ps) AS text FROM s_""",
)
def sentence_paragraphs(spark, sf_dir):
    return ops.sentence_paragraphs(table(spark, sf_dir, "documents"))


@REGISTRY.add(
    "wrap_chunks",
    r"""WITH s_ AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM documents),
    f_ AS (SELECT doc_id, list_reduce(list_transform(ws, lambda w: [w]),
             lambda acc, x: CASE WHEN acc[len(acc)] = '' THEN list_append(acc[1:len(acc) - 1], x[1])
                              WHEN length(acc[len(acc)]) + 1 + length(x[1]) <= 94 THEN list_append(acc[1:len(acc) - 1], acc[len(acc)] || ' ' || x[1])
                              ELSE list_append(acc, x[1]) END, ['']) AS ls FROM s_)
    SELECT doc_id, unnest(range(1, len(coalesce(ls, [''])) + 1)) AS line_no, unnest(coalesce(ls, [''])) AS line FROM f_""",
)
def wrap_chunks(spark, sf_dir):
    return ops.wrap_chunks(table(spark, sf_dir, "documents"))


_PLAIN = "translate(regexp_replace(text, '…', '...', 'g'), '–—―‘’‚“”„', '---''''''\"\"\"')"
_ASCII = f"regexp_replace(strip_accents({_PLAIN}), '[^\\x20-\\x7E]', '', 'g')"


def _latin(to: str) -> str:
    return f"regexp_replace({_PLAIN}, '[^\\x09\\x0A\\x0D\\x20-\\x7E\\x{{A0}}-\\x{{FF}}]', '{to}', 'g')"


@REGISTRY.add(
    "latin1_fold",
    f"""SELECT doc_id, md5({_latin('?')}) AS mark_md5, md5({_latin('')}) AS drop_md5, md5({_ASCII}) AS ascii_md5,
    {_latin('?')} <> text AS mark_changed, {_latin('')} <> text AS drop_changed, {_ASCII} <> text AS ascii_changed FROM documents""",
)
def latin1_fold(spark, sf_dir):
    return ops.latin1_report(table(spark, sf_dir, "documents"))


@REGISTRY.add(
    "write_document_text",
    f"WITH {PAGES} SELECT doc_id, string_agg(text, chr(10) || chr(10) || '--- PAGE ---' || chr(10) || chr(10) ORDER BY page_no) AS text FROM pages_ GROUP BY 1",
)
def write_document_text(spark, sf_dir):
    return ops.document_text(doc_pages(spark, sf_dir))


@REGISTRY.add(
    "page_labels",
    f"WITH {PAGES} SELECT doc_id, page_no, 'p. ' || (page_no + 4) AS label, (page_no + 4) || ' of ' || (count(*) OVER (PARTITION BY doc_id) + 4) AS long_label FROM pages_",
)
def page_labels(spark, sf_dir):
    return ops.page_labels(doc_pages(spark, sf_dir), start=5)


@REGISTRY.add(
    "region_redaction",
    f"""WITH {WORDS}, {REGIONS}, r_ AS (SELECT * FROM regions_ WHERE w > 0 AND h > 0)
    SELECT *, EXISTS (SELECT 1 FROM r_ WHERE r_.doc_id = words_.doc_id AND r_.page_no = words_.page_no AND words_.x < r_.x + r_.w AND words_.x + words_.w > r_.x AND words_.y < r_.y + r_.h AND words_.y + words_.h > r_.y) AS hit FROM words_""",
)
def region_redaction(spark, sf_dir):
    marks = regions(spark, sf_dir)
    return ops.region_redaction(words(ops.with_regions(doc_pages(spark, sf_dir), marks), "regions"), marks)


@REGISTRY.add(
    "redact_pages",
    f"""WITH {PAGES}, {REGIONS}, r_ AS (SELECT doc_id, page_no, count(*) AS n FROM regions_ WHERE w > 0 AND h > 0 GROUP BY ALL)
    SELECT p.doc_id, p.page_no, CASE WHEN n > 0 THEN '' ELSE text END AS text, coalesce(n, 0) AS redactions, CASE WHEN p.doc_id NOT IN (SELECT doc_id FROM r_) THEN 'no region' END AS error
    FROM pages_ p LEFT JOIN r_ ON p.doc_id = r_.doc_id AND p.page_no = r_.page_no""",
)
def redact_pages(spark, sf_dir):
    return ops.redact_pages(doc_pages(spark, sf_dir), regions(spark, sf_dir))


@REGISTRY.add(
    "redaction_leak_check",
    f"""WITH {PAGES}, c_ AS (SELECT doc_id, count(*) AS pages_before, count(*) - CASE WHEN doc_id % 70 = 0 AND count(*) > 1 THEN 1 ELSE 0 END AS pages_after,
      coalesce(max(CASE WHEN page_no = 1 AND doc_id % 30 = 0 THEN length(trim(text)) + 12 WHEN page_no = 1 AND doc_id % 40 = 0 THEN length(trim(text)) END), 0)::BIGINT AS left_chars,
      coalesce(max(CASE WHEN page_no = 1 AND (doc_id % 30 = 0 OR doc_id % 40 = 0 AND contains(text, 'password=')) THEN 1 END), 0)::BIGINT AS secrets FROM pages_ WHERE doc_id % 10 = 0 GROUP BY 1)
    SELECT *, left_chars = 0 AND secrets = 0 AND pages_before = pages_after AS ok FROM c_""",
)
def redaction_leak_check(spark, sf_dir):
    """Redacted pages, of which some get their text back, with and without a secret, and some documents lose
    their last page."""
    pages, marks = doc_pages(spark, sf_dir), regions(spark, sf_dir)
    d, first = F.col("doc_id"), F.col("page_no") == 1
    own = pages.select("doc_id", "page_no", F.col("text").alias("was"))
    done = ops.redact_pages(pages, marks).join(own, ["doc_id", "page_no"])
    leak = F.when(first & (d % 30 == 0), F.concat(F.lit("password=abc"), F.trim("was"))).when(first & (d % 40 == 0), F.col("was")).otherwise(F.col("text"))
    last = F.max("page_no").over(W.partitionBy("doc_id"))
    done = done.withColumn("text", leak).withColumn("last", last).where((d % 70 != 0) | (F.col("last") == 1) | (F.col("page_no") < F.col("last"))).drop("was", "last")
    return ops.leak_check(pages, done, marks, secret="password=")


@REGISTRY.add(
    "assemble_lines",
    f"""WITH {WORDS}, l_ AS (SELECT * REPLACE (x + CASE WHEN idx % 7 = 3 THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END AS x), round(y / 0.0083::DOUBLE) AS line FROM words_),
    g_ AS (SELECT *, x - max(x + w) OVER (PARTITION BY doc_id, page_no, line ORDER BY x, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM l_),
    n_ AS (SELECT *, CASE WHEN gap IS NULL OR gap <= h * -0.2::DOUBLE OR gap >= h * 2.0::DOUBLE THEN 1 ELSE 0 END AS new FROM g_),
    r_ AS (SELECT *, (sum(new) OVER (PARTITION BY doc_id, page_no, line ORDER BY x, idx))::BIGINT AS run FROM n_)
    SELECT doc_id, page_no, line, run, string_agg(text, ' ' ORDER BY x, idx) AS text, min(x) AS x0, max(x + w) AS x1, max(h) AS h FROM r_ GROUP BY ALL""",
)
def assemble_lines(spark, sf_dir):
    """Every seventh word is moved to the right, so that lines fall into runs."""
    moved = F.when(F.col("idx") % 7 == 3, 0.02).otherwise(0.0)
    return ops.assemble_lines(words(together(doc_pages(spark, sf_dir))).withColumn("x", F.col("x") + moved), high=2.0, by_page=True)


TSV = f"""{PAGES}, lines_ AS (SELECT doc_id, page_no, CASE WHEN page_no % 5 = 0 THEN '4' ELSE '5' END || chr(9) || '1' || chr(9) || '1' || chr(9) || '1' || chr(9) || '1' || chr(9) || page_no || chr(9)
  || CASE WHEN page_no % 3 = 0 THEN 'bad' WHEN page_no % 4 = 0 THEN 'NaN' ELSE (page_no * 10)::VARCHAR END || chr(9) || '2' || chr(9) || '30' || chr(9) || '12' || chr(9) || ((doc_id * 7 + page_no * 13) % 100) || chr(9) || CASE WHEN doc_id % 9 = 0 THEN chr(9) || ' ' WHEN doc_id % 9 = 1 THEN chr(9) || text || chr(160) ELSE text END AS value FROM pages_)"""


@REGISTRY.add(
    "read_ocr_tsv",
    f"""WITH {TSV}, c_ AS (SELECT doc_id, page_no, string_split(value, chr(9)) AS c FROM lines_),
    d_ AS (SELECT *, CASE WHEN page_no % 12 IN (4, 8) OR page_no % 3 = 0 THEN 0 ELSE try_cast(c[7] AS DOUBLE) END AS x, regexp_replace(array_to_string(c[12:], chr(9)), '^{SPACE}+|{SPACE}+$', '', 'g') AS text FROM c_)
    SELECT doc_id, page_no, x, coalesce(try_cast(c[8] AS DOUBLE), 0) AS y, coalesce(try_cast(c[9] AS DOUBLE), 0) AS w, coalesce(try_cast(c[10] AS DOUBLE), 0) AS h,
    try_cast(c[11] AS DOUBLE) AS conf, text FROM d_ WHERE c[1] = '5' AND len(c) >= 12 AND text <> '' AND try_cast(c[11] AS DOUBLE) >= 20""",
)
def read_ocr_tsv(spark, sf_dir):
    """Lines of words: some with bad numbers, some of a tab and a space alone, some with white space around."""
    level = F.when(F.col("page_no") % 5 == 0, "4").otherwise("5")
    x = F.when(F.col("page_no") % 3 == 0, "bad").when(F.col("page_no") % 4 == 0, "NaN").otherwise((F.col("page_no") * 10).cast("string"))
    conf = ((F.col("doc_id") * 7 + F.col("page_no") * 13) % 100).cast("string")
    one = F.lit("1")
    text = F.when(F.col("doc_id") % 9 == 0, "\t ").when(F.col("doc_id") % 9 == 1, F.concat(F.lit("\t"), "text", F.lit("\u00a0"))).otherwise(F.col("text"))
    lines = doc_pages(spark, sf_dir).select("doc_id", "page_no", F.concat_ws("\t", level, one, one, one, one, F.col("page_no").cast("string"), x, F.lit("2"), F.lit("30"), F.lit("12"), conf, text).alias("value"))
    return ops.read_ocr_tsv(lines)


ITEMS = f"""{WORDS}, i_ AS (SELECT doc_id, page_no, idx, CASE WHEN idx % 11 = 5 THEN 'A B C' WHEN idx % 6 = 0 THEN text || ' ' ELSE text END AS text, (idx % 12) * 50.0::DOUBLE + ((idx * idx) % 5) * 3.0::DOUBLE AS x,
  (idx // 12) * 10.0::DOUBLE AS baseline, CASE WHEN idx % 4 = 1 THEN 49.0::DOUBLE ELSE 36.0::DOUBLE END AS width, CASE WHEN idx % 10 = 0 THEN 'Bold' ELSE 'Plain' END AS font, 16.0::DOUBLE + 0.3::DOUBLE * (idx % 3) AS size FROM words_)"""


def items(spark, sf_dir):
    """Words as items of a layout in points, with other fonts, sizes, gaps and letter-spaced ones by rule."""
    i = F.col("idx")
    text = F.when(i % 11 == 5, "A B C").when(i % 6 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    return words(together(doc_pages(spark, sf_dir))).select(
        "doc_id", "page_no", "idx", text.alias("text"), ((i % 12) * F.lit(50.0) + ((i * i) % 5) * F.lit(3.0)).alias("x"), (F.floor(i / 12) * F.lit(10.0)).alias("baseline"),
        F.when(i % 4 == 1, 49.0).otherwise(36.0).alias("width"), F.when(i % 10 == 0, "Bold").otherwise("Plain").alias("font"), (F.lit(16.0) + F.lit(0.3) * (i % 3)).alias("size"),
    )


@REGISTRY.add(
    "merge_runs",
    f"""WITH RECURSIVE {ITEMS}, l_ AS (SELECT *, round(baseline / 5.0::DOUBLE) AS line, row_number() OVER (PARTITION BY doc_id, page_no, round(baseline / 5.0::DOUBLE) ORDER BY x, idx) AS rn,
      CASE WHEN regexp_matches(text, '^(\\S ){{2,}}\\S$') THEN replace(text, ' ', '') ELSE text END AS t FROM i_),
    w_ AS (SELECT doc_id, page_no, line, rn, 1 AS run, font, size, baseline, x + width AS "right", t, t AS part FROM l_ WHERE rn = 1
      UNION ALL
      SELECT n.doc_id, n.page_no, n.line, n.rn, CASE WHEN joins THEN n.run ELSE n.run + 1 END, n.own_font, CASE WHEN joins THEN n.size ELSE own_size END, CASE WHEN joins THEN n.baseline ELSE own_base END, own_right, own_t,
        CASE WHEN joins AND gap > 0.12::DOUBLE * own_size AND n.t NOT LIKE '% ' AND own_t NOT LIKE ' %' THEN ' ' || own_t ELSE own_t END
      FROM (SELECT w_.doc_id, w_.page_no, w_.line, l_.rn, w_.run, w_.size, w_.baseline, w_.t, l_.font AS own_font, l_.size AS own_size, l_.baseline AS own_base, l_.x + l_.width AS own_right, l_.t AS own_t, l_.x - w_."right" AS gap,
              w_.font = l_.font AND abs(w_.size - l_.size) < 0.5 AND abs(w_.baseline - l_.baseline) < 0.35::DOUBLE * l_.size AND l_.x - w_."right" > -0.3::DOUBLE * l_.size AND l_.x - w_."right" < 0.9::DOUBLE * l_.size AS joins
            FROM w_ JOIN l_ ON l_.doc_id = w_.doc_id AND l_.page_no = w_.page_no AND l_.line = w_.line AND l_.rn = w_.rn + 1) n)
    SELECT w_.doc_id, w_.page_no, w_.line, run, count(*)::INT AS items, string_agg(part, '' ORDER BY w_.rn) AS text, arg_min(l_.x, w_.rn) AS x, arg_max(w_."right", w_.rn) - arg_min(l_.x, w_.rn) AS width,
      arg_min(w_.baseline, w_.rn) AS baseline, arg_min(w_.font, w_.rn) AS font, arg_min(w_.size, w_.rn) AS size
    FROM w_ JOIN l_ ON l_.doc_id = w_.doc_id AND l_.page_no = w_.page_no AND l_.line = w_.line AND l_.rn = w_.rn GROUP BY ALL""",
)
def merge_runs(spark, sf_dir):
    return ops.merge_runs(items(spark, sf_dir), line_height=5.0, by_page=True)


@REGISTRY.add(
    "capped_lists",
    f"WITH {PAGES} SELECT doc_id, array_to_string(list(page_no ORDER BY page_no)[1:12], ', ') || CASE WHEN count(*) > 12 THEN '...' ELSE '' END AS pages, count(*) AS n FROM pages_ GROUP BY 1",
)
def capped_lists(spark, sf_dir):
    return ops.capped_lists(doc_pages(spark, sf_dir))


@REGISTRY.add(
    "inspect_corpus",
    f"""WITH {PAGES}, s_ AS (SELECT doc_id, count(*) AS pages, sum(strlen(text))::BIGINT * 1000 AS bytes, coalesce(sum(length(text)) FILTER (page_no <= 3), 0)::BIGINT AS head_chars FROM pages_ GROUP BY 1),
    a_ AS (SELECT *, bytes / pages::DOUBLE AS avg_bytes FROM s_)
    SELECT *, CASE WHEN bytes < 8388608 AND avg_bytes < 75000 AND head_chars > 900 THEN 'basic' WHEN avg_bytes > 700000 AND head_chars < 250 THEN 'maximum'
                   WHEN avg_bytes > 320000 OR bytes > 125829120 THEN 'high' ELSE 'medium' END AS tier FROM a_""",
)
def inspect_corpus(spark, sf_dir):
    return ops.inspect_corpus(doc_pages(spark, sf_dir))


@REGISTRY.add(
    "target_feasibility",
    f"""WITH {PAGES}, s_ AS (SELECT doc_id, count(*) AS pages, sum(strlen(text))::BIGINT * 1000 AS bytes FROM pages_ GROUP BY 1),
    l_ AS (SELECT *, greatest(524288, pages * 7000 + 120000) AS least FROM s_),
    f_ AS (SELECT *, list_filter([0.5::DOUBLE, 1.0, 1.5, 3.0, 5.0], lambda t: t * 1048576 < bytes AND t * 1048576 >= least) AS fits FROM l_)
    SELECT doc_id, pages, bytes, least, array_to_string(fits, ',') AS targets,
           CASE WHEN len(fits) > 0 THEN greatest(6000, floor(list_min(fits) * 1048576 * 0.82::DOUBLE / pages)::BIGINT) END AS page_budget FROM f_""",
)
def target_feasibility(spark, sf_dir):
    return ops.target_feasibility(doc_pages(spark, sf_dir), [0.5, 1.0, 1.5, 3.0, 5.0])
