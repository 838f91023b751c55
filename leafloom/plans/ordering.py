"""Queries about order: offsets, contents, outlines and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom.operators import ordering as ops
from leafloom.plans import REGISTRY
from leafloom.plans.sql import PAGES
from leafloom.sources.derived import doc_pages, table

FILES = """f_ AS (SELECT source, doc_id, len(string_split(text, chr(10))) AS pages, CASE WHEN doc_id % 6 = 0 THEN ' .TXT' ELSE lang || '-' || doc_id || '.txt' END AS title,
  CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE ' ' || lang || ' ' END AS category, strlen(text) AS size FROM documents)"""

SPECS = f"""{FILES}, s_ AS (SELECT source, doc_id, coalesce(nullif(trim(regexp_replace(title, '(?i)\\.(txt|pdf)$', '')), ''), 'Document ' || doc_id) AS title, nullif(trim(category), '') AS category,
  coalesce(sum(pages) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_page, pages FROM f_)"""


def files(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "source", d, F.size(F.split("text", "\n", -1)).cast("long").alias("pages"), F.when(d % 6 == 0, " .TXT").otherwise(F.concat("lang", F.lit("-"), d, F.lit(".txt"))).alias("title"),
        F.when(d % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "lang", F.lit(" "))).alias("category"), F.octet_length("text").cast("long").alias("size"),
    )


@REGISTRY.add(
    "append_ordered_sources",
    f"""WITH {PAGES}, d_ AS (SELECT p.*, CASE WHEN lang = 'fr' THEN 0 WHEN lang = 'en' THEN 1 ELSE 2 END AS src_ord FROM pages_ p JOIN documents USING (doc_id))
    SELECT doc_id, page_no, text, src_ord, row_number() OVER (PARTITION BY src_ord ORDER BY doc_id NULLS FIRST, page_no) AS src_page FROM (SELECT * REPLACE (nullif(doc_id, (SELECT max(doc_id) FROM documents)) AS doc_id) FROM d_)""",
)
def append_ordered_sources(spark, sf_dir):
    """Three sources by language; the last document has no id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    last = docs.agg(F.max("doc_id").alias("last"))
    pages = doc_pages(spark, sf_dir).join(docs, "doc_id").join(last).withColumn("doc_id", F.when(F.col("doc_id") != F.col("last"), F.col("doc_id"))).drop("last")  # one row
    parts = [pages.where("lang = 'fr'"), pages.where("lang = 'en'"), pages.where("lang NOT IN ('fr', 'en')")]
    return ops.append_ordered([p.drop("lang") for p in parts])


@REGISTRY.add("page_offsets", f"WITH {SPECS} SELECT * FROM s_")
def page_offsets(spark, sf_dir):
    return ops.page_offsets(files(spark, sf_dir))


@REGISTRY.add(
    "table_of_contents",
    f"""WITH {SPECS}, o_ AS (SELECT * REPLACE (CASE WHEN doc_id % 19 = 0 THEN -5 WHEN doc_id % 23 = 0 THEN first_page + 1000000000 WHEN doc_id % 29 = 0 THEN NULL ELSE first_page END AS first_page), sum(pages) OVER (PARTITION BY source) AS total FROM s_),
    n_ AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first_page, doc_id) AS n, ceil(count(*) OVER (PARTITION BY source) / 27.0)::BIGINT AS tp FROM o_ WHERE first_page >= 0 AND first_page < total)
    SELECT source, doc_id, title, (n - 1) // 27 + 1 AS toc_page, (n - 1) % 27 + 1 AS row, tp + first_page + 1 AS shown_page FROM n_""",
)
def table_of_contents(spark, sf_dir):
    """Of the entries some lie before the first page, some behind the last, and some have no page."""
    d, first = F.col("doc_id"), F.col("first_page")
    moved = F.when(d % 19 == 0, F.lit(-5)).when(d % 23 == 0, first + 1_000_000_000).when(d % 29 != 0, first)
    return ops.table_of_contents(ops.page_offsets(files(spark, sf_dir)).withColumn("first_page", moved))


@REGISTRY.add(
    "outline_tree",
    f"""WITH {SPECS}, t_ AS (SELECT *, doc_id % 8 = 0 OR category IS NULL AS top FROM s_),
    n_ AS (SELECT source, 'c:' || category AS node, NULL AS parent, min(first_page) AS page, min(doc_id) AS tie, 0 AS kind, count(*) AS children FROM t_ WHERE NOT top GROUP BY source, category
           UNION ALL SELECT source, 'd:' || doc_id, CASE WHEN NOT top THEN 'c:' || category END, first_page, doc_id, 1, 0 FROM t_)
    SELECT source, node, parent, row_number() OVER l AS ord, lag(node) OVER l AS prev, lead(node) OVER l AS next, children FROM n_ WINDOW l AS (PARTITION BY source, parent ORDER BY page, tie, kind)""",
)
def outline_tree(spark, sf_dir):
    return ops.outline_tree(ops.page_offsets(files(spark, sf_dir)).withColumn("root", F.col("doc_id") % 8 == 0))


def _fold(size_list: str, max_items: int, max_size: int) -> str:
    """[group, items, bytes] after each element, as a list reduce."""
    return f"""list_reduce(list_transform({size_list}, lambda s: [[s]]),
      lambda acc, x: list_append(acc, CASE WHEN acc[len(acc)][1] > 0 AND acc[len(acc)][2] < {max_items} AND acc[len(acc)][3] + x[1][1] <= {max_size}
        THEN [acc[len(acc)][1], acc[len(acc)][2] + 1, acc[len(acc)][3] + x[1][1]] ELSE [acc[len(acc)][1] + 1, 1, x[1][1]] END), [[0::BIGINT, 0, 0]])"""


@REGISTRY.add(
    "pack_sequential",
    f"""WITH {FILES}, l_ AS (SELECT nullif(source, 'src3') AS source, list(doc_id ORDER BY doc_id) AS ids, list(size ORDER BY doc_id) AS sizes FROM f_ GROUP BY 1),
    p_ AS (SELECT source, ids, sizes, {_fold('sizes', 20, 20480)} AS g FROM l_)
    SELECT source, unnest(ids) AS doc_id, unnest(sizes) AS size, unnest(list_transform(g[2:], lambda x: x[1])) AS grp FROM p_""",
)
def pack_sequential(spark, sf_dir):
    """Files by source; one of the sources has no name."""
    own = files(spark, sf_dir).select(F.nullif("source", F.lit("src3")).alias("source"), "doc_id", "size")
    return ops.pack_sequential(own, "source", ["doc_id"], 20, 20_480)


@REGISTRY.add(
    "split_by_budget",
    f"""WITH {PAGES}, l_ AS (SELECT doc_id, list(page_no ORDER BY page_no) AS nos, list(strlen(text) ORDER BY page_no) AS sizes FROM pages_ GROUP BY 1),
    p_ AS (SELECT doc_id, nos, sizes, {_fold('sizes', 1000000000, 600)} AS g FROM l_),
    u_ AS (SELECT doc_id, unnest(nos) AS no, unnest(sizes) AS size, unnest(list_transform(g[2:], lambda x: x[1])) AS part FROM p_)
    SELECT doc_id, part, min(no) AS first_page, max(no) AS last_page, sum(size)::BIGINT AS bytes FROM u_ GROUP BY ALL""",
)
def split_by_budget(spark, sf_dir):
    return ops.split_by_budget(doc_pages(spark, sf_dir).withColumn("size", F.octet_length("text")), 600)


@REGISTRY.add(
    "run_totals",
    f"""WITH {FILES}, t_ AS (SELECT source, count(*) AS files, sum(size)::BIGINT AS bytes FROM f_ GROUP BY 1)
    SELECT *, CASE WHEN files >= 100 OR bytes >= 150000 THEN 'massive' WHEN files <= 48 AND bytes <= 90000 THEN 'direct' ELSE 'batched' END AS mode FROM t_""",
)
def run_totals(spark, sf_dir):
    return ops.run_totals(files(spark, sf_dir), massive_bytes=150_000, direct_bytes=90_000)
