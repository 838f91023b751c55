"""Queries about integrity reports and preparation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom.functions.text import canonical_json
from leafloom.operators import integrity as ops
from leafloom.plans import REGISTRY
from leafloom.sources.derived import table

MANIFEST = """m_ AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS name, strlen(coalesce(text, '')) AS size_bytes, len(string_split(coalesce(text, ''), chr(10))) AS pages, sha256(coalesce(text, '')) AS sha256 FROM documents)"""


def manifest(spark, sf_dir):
    return ops.build_manifest(table(spark, sf_dir, "documents"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")))


@REGISTRY.add("file_quarantine", """SELECT page_id, strlen(html) >= 8 AND contains(html[1:1024], '<html lang="en">') AS ok FROM pages""")
def file_quarantine(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    return ops.quarantine(files, '<html lang="en">').drop("content")


@REGISTRY.add("build_manifest", f"WITH {MANIFEST} SELECT * FROM m_")
def build_manifest(spark, sf_dir):
    return manifest(spark, sf_dir)


_RUN = r"r_ AS (SELECT doc_id, length(text) AS before, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE length(regexp_replace(trim(text), '\s+', ' ', 'g')) END AS after FROM documents)"


def _run(spark, sf_dir):
    short = F.length(F.regexp_replace(F.trim("text"), r"\s+", " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("before"), F.when(F.col("doc_id") % 17 != 0, short.cast("long")).alias("after"))


@REGISTRY.add(
    "batch_run_report",
    f"""WITH {_RUN}, a_ AS (SELECT doc_id, before, CASE WHEN before <= 400 THEN before ELSE after END AS after FROM r_)
    SELECT doc_id, CASE WHEN coalesce(after, 0) <= 0 THEN 'ERROR' ELSE 'OK' END AS state, before, CASE WHEN after > 0 THEN after END AS after,
           CASE WHEN after > 0 THEN round((before - after) * 100.0::DOUBLE / before, 1) END AS reduction FROM a_""",
)
def batch_run_report(spark, sf_dir):
    return ops.batch_run_report(_run(spark, sf_dir), target=400)


@REGISTRY.add(
    "batch_run_totals",
    f"""WITH {_RUN}, a_ AS (SELECT CASE WHEN before <= 400 THEN before ELSE after END AS after, before FROM r_)
    SELECT CASE WHEN coalesce(after, 0) <= 0 THEN 'ERROR' ELSE 'OK' END AS state, count(*) AS files, sum(before)::BIGINT AS before, coalesce(sum(after), 0)::BIGINT AS after FROM a_ GROUP BY 1""",
)
def batch_run_totals(spark, sf_dir):
    rows = ops.batch_run_report(_run(spark, sf_dir), target=400)
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("files"), F.sum("before").alias("before"), F.coalesce(F.sum("after"), F.lit(0)).alias("after"))


_JSON = f"""{MANIFEST}, j_ AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'not json' ELSE
  '{{"schema":"' || CASE WHEN doc_id % 13 = 0 THEN 'other/2' ELSE 'integrity-report/1' END || '","reportId":"IR-' || doc_id || '"' || CASE WHEN doc_id % 7 = 0 THEN '' ELSE ',"reportSha256":"' || md5(doc_id::VARCHAR) || '"' END
  || ',"output":{{"name":"' || name || '","sizeBytes":' || size_bytes || ',"pages":' || pages || ',"sha256":"' || sha256 || '"}}}}' END AS value FROM m_)"""


def _report_lines(spark, sf_dir):
    m = manifest(spark, sf_dir)
    tag = F.when(F.col("doc_id") % 13 == 0, "other/2").otherwise(ops.REPORT_TAG)
    output = F.struct("name", F.col("size_bytes").alias("sizeBytes"), "pages", "sha256").alias("output")
    hash_ = F.when(F.col("doc_id") % 7 != 0, F.md5(F.col("doc_id").cast("string")))
    value = F.to_json(F.struct(tag.alias("schema"), F.concat(F.lit("IR-"), "doc_id").alias("reportId"), hash_.alias("reportSha256"), output))
    return m.select("doc_id", F.when(F.col("doc_id") % 11 == 0, "not json").otherwise(value).alias("value"))


@REGISTRY.add(
    "read_reports_json",
    f"""WITH {_JSON}, p_ AS (SELECT doc_id, CASE WHEN json_valid(value) THEN value::JSON END AS v FROM j_)
    SELECT doc_id, v->>'$.reportId' AS report_id, v->>'$.reportSha256' AS report_sha256, v->>'$.output.name' AS name, (v->>'$.output.sizeBytes')::BIGINT AS size_bytes, (v->>'$.output.pages')::BIGINT AS pages, v->>'$.output.sha256' AS sha256
    FROM p_ WHERE v->>'$.schema' = 'integrity-report/1' AND v->>'$.reportSha256' IS NOT NULL""",
)
def read_reports_json(spark, sf_dir):
    good, _ = ops.read_reports(_report_lines(spark, sf_dir))
    return good.select("doc_id", F.col("reportId").alias("report_id"), F.col("reportSha256").alias("report_sha256"), "output.name", F.col("output.sizeBytes").alias("size_bytes"), "output.pages", "output.sha256")


@REGISTRY.add(
    "reports_rejected",
    f"WITH {_JSON} SELECT CASE WHEN doc_id % 11 = 0 THEN 'json' WHEN doc_id % 13 = 0 THEN 'schema' ELSE 'fields' END AS why, count(*) AS n FROM j_ WHERE doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 7 = 0 GROUP BY 1",
)
def reports_rejected(spark, sf_dir):
    _, bad = ops.read_reports(_report_lines(spark, sf_dir))
    tag = F.get_json_object("value", "$.schema")
    return bad.groupBy(F.when(tag.isNull(), "json").when(tag != ops.REPORT_TAG, "schema").otherwise("fields").alias("why")).agg(F.count(F.lit(1)).alias("n"))


_STEPS_SQL = "['remove-blank', 'compress', 'ocr', 'remove-metadata', 'watermark', 'page-numbers', 'pdfa']"


@REGISTRY.add(
    "step_chain_report",
    f"""WITH d_ AS (SELECT doc_id, strlen(text) AS bytes, 0.5::DOUBLE + (doc_id % 5) / 10.0::DOUBLE AS factor, list_filter({_STEPS_SQL}, lambda s: (doc_id + length(s)) % 3 <> 0) AS steps FROM documents),
    r_ AS (SELECT doc_id, bytes, factor, unnest(steps) AS step, unnest(range(1, len(steps) + 1)) AS ord FROM d_),
    p_ AS (SELECT *, sum(CASE WHEN step IN ('compress', 'remove-metadata') THEN 1 ELSE 0 END) OVER w AS power FROM r_ WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
    a_ AS (SELECT *, floor(bytes * pow(factor, power))::BIGINT AS after FROM p_),
    b_ AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY doc_id ORDER BY ord), bytes) AS before FROM a_),
    c_ AS (SELECT *, (after - before) * 100.0::DOUBLE / before AS ch FROM b_)
    SELECT doc_id, ord, step, before, after, CASE WHEN before = 0 THEN '0%' WHEN abs(ch) < 0.05 THEN 'no change in size' WHEN ch < 0 THEN round(-ch, 1) || '% smaller' ELSE round(ch, 1) || '% larger' END AS change FROM c_""",
)
def step_chain_report(spark, sf_dir):
    on = F.filter(F.array(*map(F.lit, ops.STEPS)), lambda s: (F.col("doc_id") + F.length(s)) % 3 != 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), on.alias("enabled"), (F.lit(0.5) + F.col("doc_id") % 5 / 10.0).alias("factor"))
    return ops.step_chain(docs)


_RESULTS = """v_ AS (SELECT doc_id, len(string_split(text, chr(10))) AS op, doc_id % 3 AS rp, len(string_split(text, chr(10))) - doc_id % 3 + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS fp,
  strlen(text) AS fb, CASE WHEN doc_id % 2 = 0 THEN 0.002::DOUBLE END AS mb, doc_id % 3 = 0 AS ocr, doc_id % 4 = 0 AS metadata, doc_id % 5 = 0 AS pdfa FROM documents)"""


@REGISTRY.add(
    "validation_rollup",
    f"""WITH {_RESULTS} SELECT doc_id, 2 + CASE WHEN op - rp = fp THEN 1 ELSE 0 END + CASE WHEN mb IS NOT NULL AND fb <= 0.1::DOUBLE * 1048576 THEN 1 ELSE 0 END AS passed,
    CASE WHEN op - rp = fp THEN 0 ELSE 1 END + CASE WHEN mb IS NOT NULL AND fb > 0.1::DOUBLE * 1048576 THEN 1 ELSE 0 END AS warning,
    1 + ocr::INT + metadata::INT + pdfa::INT AS info FROM v_""",
)
def validation_rollup(spark, sf_dir):
    d, pages = F.col("doc_id"), F.size(F.split("text", "\n", -1))
    rows = table(spark, sf_dir, "documents").select(
        d, pages.alias("original_pages"), (d % 3).alias("removed_pages"), (pages - d % 3 + F.when(d % 19 == 0, 1).otherwise(0)).alias("final_pages"), F.octet_length("text").alias("final_bytes"),
        F.when(d % 2 == 0, 0.002).alias("target_mb"), (d % 3 == 0).alias("ocr"), (d % 4 == 0).alias("metadata"), (d % 5 == 0).alias("pdfa"),
    )
    return ops.validation_rollup(ops.validations(rows))


_ISSUED = f"""{MANIFEST}, i_ AS (SELECT *, 'IR-20240131-' || upper(sha256[1:12]) AS report_id FROM m_),
y_ AS (SELECT *, '{{"output":{{"name":"' || name || '","pages":' || pages || ',"sha256":"' || sha256 || '","sizeBytes":' || size_bytes || '}},"reportId":"' || report_id || '","schema":"integrity-report/1"}}' AS payload FROM i_)"""


def _issued(spark, sf_dir):
    return ops.issue_reports(manifest(spark, sf_dir), F.lit("2024-01-31").cast("date"))


@REGISTRY.add("issue_reports", f"WITH {_ISSUED} SELECT doc_id, report_id, sha256(payload) AS report_sha256 FROM y_")
def issue_reports(spark, sf_dir):
    return _issued(spark, sf_dir).select("doc_id", "report_id", "report_sha256")


@REGISTRY.add(
    "verify_reports",
    f"""WITH {_ISSUED}, t_ AS (SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN 'x' ELSE '' END || sha256(payload) AS rs, sha256(payload) AS cs,
      CASE WHEN doc_id % 2 = 0 THEN upper(sha256) ELSE sha256 END AS es, sha256 AS s, size_bytes + CASE WHEN doc_id % 29 = 0 THEN 1 ELSE 0 END AS ez, size_bytes AS z, pages AS p FROM y_),
    c_ AS (SELECT doc_id, rs = cs AND ez = z AS matched, unnest(['report-sha256', 'sha256', 'size', 'pages']) AS key, unnest([rs, es, ez::VARCHAR, p::VARCHAR]) AS expected, unnest([cs, s, z::VARCHAR, p::VARCHAR]) AS actual FROM t_)
    SELECT *, lower(expected) = lower(actual) AS ok FROM c_""",
)
def verify_reports(spark, sf_dir):
    d = F.col("doc_id")
    issued = _issued(spark, sf_dir)
    reports = issued.select(
        d, F.when(d % 23 == 0, F.concat(F.lit("x"), "report_sha256")).otherwise(F.col("report_sha256")).alias("report_sha256"), F.col("report_sha256").alias("computed_sha256"),
        F.when(d % 2 == 0, F.upper("sha256")).otherwise(F.col("sha256")).alias("sha256"), (F.col("size_bytes") + F.when(d % 29 == 0, 1).otherwise(0)).alias("size_bytes"), "pages",
    )
    return ops.verify_reports(reports, manifest(spark, sf_dir))


@REGISTRY.add(
    "canonical_payloads",
    """WITH c_ AS (SELECT event_id, '{"a":{"amount":' || event_id || ',"note":null,"tags":["x",{"p":1,"q":2}]},"type":"' || event_type || '"}' AS canonical FROM events)
    SELECT event_id, sha256(canonical) AS payload_sha256 FROM c_ WHERE event_id % 13 <> 0 UNION ALL SELECT event_id, NULL FROM c_ WHERE event_id % 13 = 0""",
)
def canonical_payloads(spark, sf_dir):
    """Hashes of nested payloads whose fields stand in another order by rule; some aren't JSON."""
    k, kind = F.col("event_id"), F.col("event_type")
    one = F.format_string('{"type":"%s","a":{"note":null,"tags":["x",{"q":2,"p":1}],"amount":%d}}', kind, k)
    two = F.format_string('{ "a" : {"tags": ["x", {"p": 1, "q": 2}], "amount": %2$d, "note": null}, "type": "%1$s" }', kind, k)
    text = F.when(k % 13 == 0, "{not json").when(k % 2 == 0, one).otherwise(two)
    return table(spark, sf_dir, "events").select("event_id", F.sha2(canonical_json(text), 256).alias("payload_sha256"))
