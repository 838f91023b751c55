"""Queries over keyed tables and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom.functions.text import font_class, is_letter_spaced, output_name, setting_labels
from leafloom.operators import graph, ledger
from leafloom.plans import REGISTRY
from leafloom.plans.sql import EDGES
from leafloom.sources.derived import edges, table


@REGISTRY.add("insert_ignore", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, c_name || '!' FROM customer WHERE c_custkey % 3 = 0")
def insert_ignore(spark, sf_dir):
    """Two thirds of the customers are there; all arrive, twice and with another name."""
    all_ = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    late = all_.withColumn("c_name", F.concat("c_name", F.lit("!")))
    return ledger.insert_ignore(all_.where("c_custkey % 3 > 0"), late.unionByName(late), "c_custkey")


@REGISTRY.add(
    "registry_upsert",
    """SELECT p_partkey AS id, p_name AS name, p_partkey AS ord, false AS built_in FROM part WHERE NOT (p_partkey % 5 = 0 AND p_partkey % 15 > 0)
    UNION ALL SELECT p_partkey, upper(p_name), (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY p_partkey), false FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 15 > 0""",
)
def registry_upsert(spark, sf_dir):
    """Every fifth part is patched; every fifteenth patch is built in."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"), F.lit(False).alias("built_in"))
    patch = parts.where("id % 5 = 0").withColumn("name", F.upper("name")).withColumn("built_in", F.col("id") % 15 == 0)
    return ledger.registry_upsert(parts, patch)


@REGISTRY.add(
    "registry_touch",
    "WITH u_ AS (SELECT o_custkey AS id, max(o_orderdate) AS ts FROM orders GROUP BY 1) SELECT c_custkey AS id, c_name AS name, greatest(CASE WHEN c_custkey % 2 = 0 THEN DATE '1995-01-01' END, ts) AS last_used FROM customer LEFT JOIN u_ ON id = c_custkey",
)
def registry_touch(spark, sf_dir):
    """Half of the customers were used in 1995, as the registry says; orders are later or earlier uses."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.lit("1995-01-01").cast("date")).alias("last_used"))
    return ledger.touch_registry(own, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("ts")))


@REGISTRY.add(
    "output_names",
    r"""SELECT doc_id, CASE WHEN row_number() OVER s < 1000 THEN lpad((row_number() OVER s)::VARCHAR, 3, '0') ELSE (row_number() OVER s)::VARCHAR END || '-' || lang || '_small.txt' AS name,
      regexp_matches(left(text, 9), '^(\S ){2,}\S$') AS spaced, CASE WHEN lang = 'de' THEN 'Times New Roman' WHEN lang = 'fr' THEN 'Courier New' ELSE 'Arial' END AS font, lang = 'en' AS bold, lang = 'es' AS italic,
      array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'OCR' END, CASE WHEN doc_id % 3 = 0 THEN 'Metadata' END], lambda x: x IS NOT NULL), ', ') AS labels
    FROM documents WINDOW s AS (PARTITION BY source, lang ORDER BY doc_id)""",
)
def output_names(spark, sf_dir):
    """Numbered outputs of each source and language, and the small classifiers of names and settings."""
    from pyspark.sql import Window as W

    number = F.row_number().over(W.partitionBy("source", "lang").orderBy("doc_id"))
    name = F.when(F.col("lang") == "de", "Georgia").when(F.col("lang") == "fr", "Mono").when(F.col("lang") == "en", "Sans-Bold").otherwise("Sans-Oblique")
    font = font_class(name, F.when(F.col("lang") == "de", "serif"))
    settings = F.create_map(F.lit("metadata"), F.col("doc_id") % 3 == 0, F.lit("ocr"), F.col("doc_id") % 2 == 0)
    labels = setting_labels(settings, [("ocr", "OCR"), ("metadata", "Metadata"), ("pdfa", "Archive")])
    rows = table(spark, sf_dir, "documents").withColumns({"number": number, "f": font})
    return rows.select("doc_id", output_name(F.col("number"), F.col("lang"), "_small.txt").alias("name"), is_letter_spaced(F.left("text", F.lit(9))).alias("spaced"), "f.font", "f.bold", "f.italic", F.array_join(labels, ", ").alias("labels"))


_LINES = """l_ AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'oops' WHEN event_id % 5 = 0 THEN '{"settings":{"k":1}}' WHEN event_id % 3 = 0 THEN '{"id":"e' || event_id || '"}' ELSE '{"id":"e' || event_id || '","settings":' || props || '}' END AS value FROM events)"""


def _lines(spark, sf_dir):
    e = F.col("event_id")
    value = F.when(e % 7 == 0, "oops").when(e % 5 == 0, '{"settings":{"k":1}}').when(e % 3 == 0, F.concat(F.lit('{"id":"e'), e, F.lit('"}'))).otherwise(F.concat(F.lit('{"id":"e'), e, F.lit('","settings":'), "props", F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", value.alias("value"))


@REGISTRY.add("read_registry_json", f"WITH {_LINES} SELECT event_id, value::JSON->>'$.id' AS id, (value::JSON->>'$.settings.k')::BIGINT AS k FROM l_ WHERE event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 3 <> 0")
def read_registry_json(spark, sf_dir):
    good, _ = ledger.read_registry(_lines(spark, sf_dir), "id STRING, settings STRUCT<k: BIGINT>")
    return good.select("event_id", "id", "settings.k")


@REGISTRY.add("registry_rejects", f"WITH {_LINES} SELECT event_id, value FROM l_ WHERE event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 3 = 0")
def registry_rejects(spark, sf_dir):
    return ledger.read_registry(_lines(spark, sf_dir), "id STRING, settings STRUCT<k: BIGINT>")[1]


_FILES = f"""{_LINES}, f_ AS (SELECT event_id // 20 AS file, CASE WHEN (event_id // 20) % 9 = 4 THEN '{{"entries":' ELSE '' END || '[' || string_agg(CASE WHEN event_id % 7 = 0 AND (event_id // 20) % 9 <> 8 THEN '{{"id":' || event_id || ',"settings":{{"k":1}}}}' ELSE value END, ', ' ORDER BY event_id) || ']'
    || CASE WHEN (event_id // 20) % 9 = 4 THEN '}}' ELSE '' END AS value FROM l_ GROUP BY event_id // 20)"""


def _files(spark, sf_dir):
    """Twenty lines each in one JSON array; of nine files one has lines that aren't JSON and one is an object."""
    e, f = F.col("event_id"), F.floor(F.col("event_id") / 20)
    number = F.concat(F.lit('{"id":'), e, F.lit(',"settings":{"k":1}}'))
    lines = _lines(spark, sf_dir).select(f.alias("file"), e, F.when((e % 7 == 0) & (f % 9 != 8), number).otherwise(F.col("value")).alias("value"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]), ", ")
    array = F.concat(F.lit("["), "listed", F.lit("]"))
    return lines.groupBy("file").agg(listed.alias("listed")).select("file", F.when(F.col("file") % 9 == 4, F.concat(F.lit('{"entries":'), array, F.lit("}"))).otherwise(array).alias("value"))


@REGISTRY.add(
    "read_registry_files",
    f"""WITH {_FILES}, g_ AS (SELECT file, CASE WHEN json_valid(value) AND file % 9 <> 4 THEN value::JSON END AS v FROM f_),
    e_ AS (SELECT file, unnest(json_extract(v, '$[*]')) AS item, unnest(range(1, json_array_length(v)::BIGINT + 1)) AS entry FROM g_ WHERE v IS NOT NULL)
    SELECT file, entry::INT AS entry, item->>'$.id' AS id, (item->>'$.settings.k')::BIGINT AS k FROM e_ WHERE json_type(item, '$.id') = 'VARCHAR' AND json_type(item, '$.settings') <> 'NULL'""",
)
def read_registry_files(spark, sf_dir):
    good, _ = ledger.read_registry_arrays(_files(spark, sf_dir))
    return good.select("file", "entry", "id", F.try_variant_get("settings", "$.k", "bigint").alias("k"))


@REGISTRY.add("registry_file_rejects", f"WITH {_FILES} SELECT file, value FROM f_ WHERE file % 9 = 4 OR NOT json_valid(value)")
def registry_file_rejects(spark, sf_dir):
    return ledger.read_registry_arrays(_files(spark, sf_dir))[1]


_REACH = f"""{EDGES}, r_(node) AS (SELECT 1::BIGINT UNION SELECT dst FROM r_ JOIN edges_ ON src = node)"""


@REGISTRY.add("static_reachability", f"WITH RECURSIVE {_REACH} SELECT node FROM r_")
def static_reachability(spark, sf_dir):
    return graph.reachable(spark, edges(spark, sf_dir), [1]).select("node")


@REGISTRY.add(
    "reachable_payload",
    f"""WITH RECURSIVE {_REACH}, o_ AS (SELECT p_name AS name, p_size * 1000 AS bytes FROM r_ JOIN part ON p_partkey = node)
    SELECT count(*) AS files, coalesce(sum(bytes), 0)::BIGINT AS bytes, count(*) FILTER (regexp_matches(name, 'widget|bolt')) AS heavy, coalesce(sum(bytes), 0) > 1200000 AS over FROM o_""".replace("AS over FROM", 'AS "over" FROM'),
)
def reachable_payload(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), (F.col("p_size").cast("long") * 1000).alias("bytes"))
    return graph.payload(spark, edges(spark, sf_dir), nodes, [1], "widget|bolt", 1_200_000)


@REGISTRY.add(
    "largest_reached",
    f"WITH RECURSIVE {_REACH} SELECT node, p_size::BIGINT * 1000 AS bytes FROM r_ JOIN part ON p_partkey = node ORDER BY bytes DESC, node LIMIT 12",
)
def largest_reached(spark, sf_dir):
    """The twelve largest files of the payload."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size").cast("long") * 1000).alias("bytes"))
    return nodes.join(graph.reachable(spark, edges(spark, sf_dir), [1]).select("node"), "node").orderBy(F.desc("bytes"), "node").limit(12)


@REGISTRY.add("closure_union", f"WITH {EDGES} SELECT src AS node FROM edges_ UNION SELECT dst FROM edges_ UNION SELECT p_partkey FROM part WHERE p_type = 'PROMO'")
def closure_union(spark, sf_dir):
    e = edges(spark, sf_dir)
    extra = table(spark, sf_dir, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("node"))
    return graph.closure_union([e.select(F.col("src").alias("node")), e.select(F.col("dst").alias("node")), extra])
