"""Queries of rule jobs over the catalogue, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafloom.operators import rules as ops
from leafloom.plans import REGISTRY
from leafloom.sources.derived import table

FOLD = "lower(strip_accents({0}))"
K = """(props::JSON->>'$.k')::BIGINT"""


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


@REGISTRY.add(
    "facet_search",
    f"""SELECT p_partkey AS id, p_name, p_type AS category, p_brand, CASE WHEN p_partkey % 10 = 0 THEN p_partkey % 50 ELSE 999 END AS rank FROM part
    WHERE p_type = 'PROMO' AND contains({FOLD.format("p_name || ' ' || p_type || ' ' || p_brand")}, {FOLD.format("'Rïng'")})""",
)
def facet_search(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", F.col("p_type").alias("category"), "p_brand")
    ranks = items.where("id % 10 = 0").select("id", (F.col("id") % 50).alias("rank"))
    return ops.facet_search(items, ranks, "PROMO", "Rïng", ["p_name", "category", "p_brand"])


@REGISTRY.add("document_search", f"SELECT doc_id AS id, lang AS category, 999 AS rank FROM documents WHERE contains({FOLD.format('text')}, {FOLD.format(repr('Étre'))})")
def document_search(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("category"))
    ranks = spark.createDataFrame([], "id bigint, rank int")
    return ops.facet_search(items, ranks, None, "Étre", ["text"]).drop("text")


@REGISTRY.add("collated_search", f"SELECT doc_id AS id, lang AS category, 999 AS rank FROM documents WHERE contains({FOLD.format('text')}, {FOLD.format(repr('Étre'))})")
def collated_search(spark, sf_dir):
    """The same needle by a collation that passes over case and accents."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("category"))
    return ops.facet_search(items, spark.createDataFrame([], "id bigint, rank int"), None, "Étre", ["text"], collation="UNICODE_CI_AI").drop("text")


RULES = [(r"^(red|blue)\b", "coloured"), (r"ring|bolt", "small part"), (r"^small", "small"), (r"wid", "widget")]


@REGISTRY.add(
    "categorize_by_rules",
    "SELECT p_partkey, p_name, CASE " + " ".join(f"WHEN regexp_matches({FOLD.format('p_name')}, '{p}') THEN '{c}'" for p, c in RULES) + " ELSE '' END AS category FROM part",
)
def categorize_by_rules(spark, sf_dir):
    return ops.categorize(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", RULES)


@REGISTRY.add(
    "category_dictionary",
    r"""WITH n_ AS (SELECT p_partkey AS ord, left(trim(regexp_replace(CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN '  ' || p_name ELSE replace(p_name, ' ', '   ') END, '\s+', ' ', 'g')), 60) AS name FROM part)
    SELECT lower(name) AS key, arg_min(name, ord) AS name, count(*) AS n, CASE WHEN lower(name) IN ('red widget', 'small ring') THEN '' ELSE arg_min(name, ord) END AS shown FROM n_ WHERE name <> '' GROUP BY lower(name)""",
)
def category_dictionary(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    spelled = F.when(k % 3 == 0, F.upper(name)).when(k % 3 == 1, F.concat(F.lit("  "), name)).otherwise(F.replace(name, F.lit(" "), F.lit("   ")))
    return ops.category_dictionary(table(spark, sf_dir, "part").select(k.alias("ord"), spelled.alias("name")), ["Red Widget", "small ring"])


@REGISTRY.add(
    "valid_identity",
    rf"""WITH i_ AS (SELECT doc_id, regexp_extract_all(text, '\S*@\S*') AS es, md5(doc_id::VARCHAR) AS h FROM documents),
    e_ AS (SELECT doc_id, h, unnest(CASE WHEN len(es) > 0 THEN es ELSE [NULL] END) AS email, unnest(range(greatest(len(es), 1))) AS pos FROM i_),
    u_ AS (SELECT doc_id, pos, email, CASE WHEN doc_id % 4 = 0 THEN h ELSE h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] END AS uid FROM e_)
    SELECT doc_id, pos, uid, email, regexp_matches(uid, '{ops.UUID}') AS uuid_ok, regexp_matches(email, '{ops.EMAIL}') AND length(email) <= 254 AS email_ok FROM u_""",
)
def valid_identity(spark, sf_dir):
    """Every word with an @ of every document, and the document's id in two spellings."""
    h = F.md5(F.col("doc_id").cast("string"))
    uid = F.when(F.col("doc_id") % 4 == 0, h).otherwise(F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)))
    found = F.regexp_extract_all("text", F.lit(r"\S*@\S*"), F.lit(0))
    rows = table(spark, sf_dir, "documents").select("doc_id", uid.alias("uid"), F.posexplode_outer(found).alias("pos", "email"))
    return ops.valid_identity(rows.withColumn("pos", F.coalesce("pos", F.lit(0))))


PRESETS = [("tiny", 0.1), ("small", 0.5), ("medium", 1.5), ("large", 3.0), ("huge", 10.0)]


@REGISTRY.add(
    "preset_compliance",
    "WITH p_ AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {m}::DOUBLE)" for n, m in PRESETS) + """) AS t(preset, target_mb)),
    r_ AS (SELECT doc_id, strlen(text) * 500 AS bytes, preset, target_mb, strlen(text) * 500 <= greatest(0.1::DOUBLE, target_mb) * 1048576 AS passes FROM documents, p_)
    SELECT *, arg_min(preset, CASE WHEN passes THEN target_mb END) OVER (PARTITION BY doc_id) AS tightest FROM r_""",
)
def preset_compliance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length("text").cast("long") * 500).alias("bytes"))
    return ops.preset_compliance(docs, PRESETS)


@REGISTRY.add("allowlist_filter", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def allowlist_filter(spark, sf_dir):
    return ops.allowlist(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ["click", "purchase", "unknown"])


@REGISTRY.add(
    "integrity_constraints",
    """WITH o_ AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey END AS custkey, CASE WHEN o_orderkey % 101 = 0 THEN 'Z' ELSE o_orderstatus END AS status, o_orderkey FROM orders),
    v_ AS (SELECT 'enum orders.status' AS rule, status AS key FROM o_ WHERE status NOT IN ('O', 'F', 'P')
      UNION ALL SELECT 'null orders.custkey', NULL FROM o_ WHERE custkey IS NULL
      UNION ALL SELECT 'unique customer.c_nationkey', c_nationkey::VARCHAR FROM customer WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey HAVING count(*) > 1
      UNION ALL SELECT 'foreign lineitem.l_orderkey', l_orderkey::VARCHAR FROM lineitem WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o_ WHERE o_orderkey % 50 <> 0 AND o_orderkey = l_orderkey))
    SELECT rule, key, count(*) AS n FROM v_ GROUP BY ALL""",
)
def integrity_constraints(spark, sf_dir):
    """Some values of orders are broken by rule, and every fiftieth order is missing as a parent."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(k, F.when(k % 97 != 0, F.col("o_custkey")).alias("custkey"), F.when(k % 101 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("status"))
    tables = {"orders": orders, "customer": table(spark, sf_dir, "customer"), "lineitem": table(spark, sf_dir, "lineitem"), "parents": orders.where("o_orderkey % 50 <> 0")}
    return ops.violations(tables, [("orders", "status", ["O", "F", "P"])], [("orders", "custkey")], [("customer", "c_nationkey")], [("lineitem", "l_orderkey", "parents", "o_orderkey")])


@REGISTRY.add("cascade_delete", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, sf_dir):
    deleted = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return ops.cascade_delete(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", deleted, "o_orderkey")


@REGISTRY.add("row_level_view", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 7")
def row_level_view(spark, sf_dir):
    return ops.row_level_view(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", 7)


@REGISTRY.add(
    "quota_check",
    """WITH u_ AS (SELECT source, lang, CASE WHEN lang = 'en' THEN 'premium' WHEN lang = 'fr' THEN 'visitor' ELSE 'account' END AS level, count(*) AS files, count(*) FILTER (length(text) < 1000) AS ocr_pages,
      CASE WHEN count(*) % 3 = 0 THEN 'maximum' ELSE 'medium' END AS mode FROM documents GROUP BY source, lang),
    l_ AS (SELECT *, CASE WHEN level = 'premium' THEN NULL WHEN files > 10 THEN 'files' WHEN ocr_pages > 10 THEN 'ocr' WHEN mode IN ('maximum', 'target') THEN 'mode' END AS reason FROM u_)
    SELECT source, lang, level, files, ocr_pages, mode, reason, reason IS NOT NULL AS blocked FROM l_""",
)
def quota_check(spark, sf_dir):
    level = F.when(F.col("lang") == "en", "premium").when(F.col("lang") == "fr", "visitor").otherwise("account")
    use = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.length("text") < 1000).alias("ocr_pages"))
    use = use.withColumn("level", level).withColumn("mode", F.when(F.col("files") % 3 == 0, "maximum").otherwise("medium"))
    limits = spark.createDataFrame([("visitor", 10, 10, ["maximum", "target"]), ("account", 10, 10, ["maximum", "target"]), ("premium", None, None, [])], "level string, max_files int, max_ocr_pages int, blocked_modes array<string>")
    return ops.quota_check(use, limits).drop("max_files", "max_ocr_pages", "blocked_modes")


@REGISTRY.add(
    "select_candidate",
    """WITH c_ AS (SELECT l_orderkey AS key, l_linenumber AS rank, l_extendedprice AS size, o_totalprice AS original, 0.3::DOUBLE * o_totalprice AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    d_ AS (SELECT key, rank, min(size) AS size, any_value(original) AS original, any_value(target) AS target FROM c_ GROUP BY key, rank),
    s_ AS (SELECT *, min(CASE WHEN size <= target THEN rank END) OVER (PARTITION BY key) AS stop FROM d_),
    t_ AS (SELECT * FROM s_ WHERE stop IS NULL OR rank <= stop)
    SELECT key, arg_min(rank, {'a': size, 'b': rank}) FILTER (size < original) AS rank, coalesce(min(size) FILTER (size < original), any_value(original)) AS size, count(*) AS tried, max(stop) IS NOT NULL AS met,
           string_agg(rank || ':' || round(size)::BIGINT, ' ' ORDER BY rank) AS log FROM t_ GROUP BY key""",
)
def select_candidate(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("rank")).agg(F.min("l_extendedprice").alias("size"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("original"), (F.lit(0.3) * F.col("o_totalprice")).alias("target"))
    out = ops.select_candidate(lines.join(orders, "key"))
    log = F.transform(F.split("log", " "), lambda x: F.concat_ws(":", F.split(x, ":")[0], F.round(F.split(x, ":")[1].cast("double")).cast("long").cast("string")))
    return out.withColumn("log", F.array_join(log, " "))


@REGISTRY.add(
    "accept_rewrite_stats",
    """WITH i_ AS (SELECT p_brand AS grp, p_type AS kind, p_size * 100 AS old_size, (p_size * 100 - (p_partkey % 20) * p_size)::BIGINT AS new_size, p_size * 10 AS pixels, 300 AS lim FROM part),
    t_ AS (SELECT *, kind IN ('STANDARD', 'PROMO', 'ECONOMY') AND new_size < 0.92::DOUBLE * old_size AS take FROM i_)
    SELECT grp, count(*) AS items, count(*) FILTER (take) AS taken, count(*) FILTER (NOT take) AS skipped, count(*) FILTER (take AND pixels > 1.2::DOUBLE * lim) AS scaled, coalesce(sum(old_size - new_size) FILTER (take), 0)::BIGINT AS saved FROM t_ GROUP BY 1""",
)
def accept_rewrite_stats(spark, sf_dir):
    size = F.col("p_size")
    items = table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_type").alias("kind"), (size * 100).alias("old_size"), (size * 100 - F.col("p_partkey") % 20 * size).alias("new_size"), (size * 10).alias("pixels"), F.lit(300).alias("limit"))
    return ops.accept_rewrites(items)


@REGISTRY.add(
    "object_audit",
    """WITH o_ AS (SELECT p_brand AS doc, split_part(p_name, ' ', 2) || (p_partkey % 7) AS font, p_partkey % 3 <> 0 AS embedded, p_size > 48 AS transparent, p_type = 'PROMO' AND p_size > 45 AS cmyk, p_partkey % 41 = 0 AS attachment FROM part),
    a_ AS (SELECT doc, list_sort(list(DISTINCT font) FILTER (NOT embedded)) AS f, bool_or(transparent) AS transparent, bool_or(cmyk) AS cmyk, bool_or(attachment) AS attachment FROM o_ GROUP BY 1)
    SELECT doc, coalesce(array_to_string(f[1:5], ', '), '') || CASE WHEN len(f) > 5 THEN '...' ELSE '' END AS fonts, coalesce(len(f), 0) AS n_fonts,
      array_to_string(list_filter([CASE WHEN len(f) > 0 THEN 'fonts not embedded' END, CASE WHEN transparent THEN 'transparency' END, CASE WHEN cmyk THEN 'cmyk without profile' END, CASE WHEN attachment THEN 'attachments removed' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM a_""",
)
def object_audit(spark, sf_dir):
    k = F.col("p_partkey")
    objects = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("doc"), F.concat(F.split("p_name", " ")[1], k % 7).alias("font"), (k % 3 != 0).alias("embedded"), (F.col("p_size") > 48).alias("transparent"),
        ((F.col("p_type") == "PROMO") & (F.col("p_size") > 45)).alias("cmyk"), (k % 41 == 0).alias("attachment"),
    )
    return ops.object_audit(objects, version=1)


@REGISTRY.add(
    "asset_inventory",
    """WITH a_ AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS page, l_partkey AS pos, coalesce(CASE WHEN l_suppkey % 3 > 0 THEN 's' || l_suppkey % 5 END, l_linenumber || ':' || l_partkey) AS ref, l_quantity AS width, l_quantity * 2 AS height FROM lineitem),
    b_ AS (SELECT *, row_number() OVER (PARTITION BY doc, ref ORDER BY page, pos, width, height) AS seen FROM a_ WHERE width >= 8 AND height >= 8)
    SELECT doc, page, pos, ref, width, height, row_number() OVER (PARTITION BY doc, page ORDER BY pos, width, height) AS number, NULL AS error FROM b_ WHERE seen = 1
    UNION ALL SELECT doc, NULL, NULL, NULL, NULL, NULL, NULL, 'no image' FROM a_ GROUP BY doc HAVING count(*) FILTER (width >= 8 AND height >= 8) = 0""",
)
def asset_inventory(spark, sf_dir):
    assets = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("pos"), F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("s"), F.col("l_suppkey") % 5)).alias("ref"), F.col("l_quantity").alias("width"), (F.col("l_quantity") * 2).alias("height")
    )
    return ops.asset_inventory(assets.distinct(), 8)


@REGISTRY.add(
    "dominant_bucket",
    """WITH b_ AS (SELECT user_id AS key, floor(value)::INT >> 3 AS bucket, count(*) AS n, min(event_id) AS first, arg_min(value, event_id) AS value FROM events GROUP BY ALL)
    SELECT key, bucket, n, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, first) AS rn FROM b_) WHERE rn = 1""",
)
def dominant_bucket(spark, sf_dir):
    return ops.dominant_bucket(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), "value"))


@REGISTRY.add(
    "array_change_ratio",
    """WITH p_ AS (SELECT a.vec_id, CASE WHEN a.vec_id % 11 IN (1, 2) THEN [] ELSE a.embedding END AS a, CASE WHEN b.vec_id % 11 IN (1, 2) THEN [] ELSE b.embedding END AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    r_ AS (SELECT vec_id, CASE WHEN len(a) <> len(b) THEN 100.0::DOUBLE WHEN len(a) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(range(0, len(a), 2), lambda i: abs(a[i + 1] - b[i + 1]) > 0.5::FLOAT)) * 100.0::DOUBLE / len(range(0, len(a), 2)) END AS ratio FROM p_)
    SELECT *, CASE WHEN ratio >= 0.8 THEN 'modified' ELSE 'unchanged' END AS status FROM r_""",
)
def array_change_ratio(spark, sf_dir):
    """Neighbours by number; of eleven vectors one is empty and one is missing."""
    k = F.col("vec_id") % 11
    vec = table(spark, sf_dir, "embeddings").select("vec_id", F.when(k == 1, F.array().cast("array<float>")).when(k != 2, F.col("embedding")).alias("a"))
    return ops.array_change_ratio(vec.join(vec.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id"), 0.5, stride=2)


@REGISTRY.add(
    "upper_median_gap",
    """WITH g_ AS (SELECT user_id AS key, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
    m_ AS (SELECT key, (list(gap ORDER BY gap))[len(list(gap)) // 2 + 1] AS median, count(*) AS gaps FROM g_ WHERE gap IS NOT NULL GROUP BY key)
    SELECT key, median, gaps, count(*) FILTER (gap > median + 3600000000) AS splits FROM g_ JOIN m_ USING (key) WHERE gap IS NOT NULL GROUP BY ALL""",
)
def upper_median_gap(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return ops.upper_median_gap(rows, 3_600_000_000)


@REGISTRY.add(
    "recent_items",
    f"""WITH l_ AS (SELECT user_id, {K} AS item, max({{'a': ts, 'b': event_id}}) AS last FROM events GROUP BY ALL)
    SELECT user_id, pos, item FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS pos FROM l_) WHERE pos <= 8""",
)
def recent_items(spark, sf_dir):
    return ops.recent_items(events(spark, sf_dir).select("user_id", F.col("k").alias("item"), "ts", F.col("event_id").alias("id")))


@REGISTRY.add(
    "favorites_fold",
    f"""WITH l_ AS (SELECT user_id, list({K} % 20 ORDER BY ts, event_id) AS items FROM events GROUP BY 1),
    f_ AS (SELECT user_id, list_reduce(list_transform(items, lambda i: [i]), lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN list_filter(acc, lambda y: y <> x[1]) ELSE list_prepend(x[1], acc)[1:12] END, []::BIGINT[]) AS f FROM l_)
    SELECT user_id, array_to_string(f, ',') AS favorites, len(f) AS n FROM f_""",
)
def favorites_fold(spark, sf_dir):
    return ops.favorites_fold(events(spark, sf_dir).select("user_id", (F.col("k") % 20).alias("item"), "ts", F.col("event_id").alias("id")))
