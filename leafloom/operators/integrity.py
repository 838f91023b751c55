"""Manifests, preparation reports and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Steps of a preparation in their order.
STEPS = ["remove-blank", "compress", "ocr", "remove-metadata", "watermark", "page-numbers", "pdfa"]
REPORT_SCHEMA = "schema STRING, reportId STRING, reportSha256 STRING, output STRUCT<name: STRING, sizeBytes: BIGINT, pages: BIGINT, sha256: STRING>"
REPORT_TAG = "integrity-report/1"


def quarantine(files: DataFrame, marker: str, min_bytes: int = 8, head: int = 1024) -> DataFrame:
    """Files (id, content) with ``ok``: long enough, and the marker stands in the first bytes, read as
    Latin-1."""
    start = F.decode(F.substring(F.col("content"), 1, head), "ISO-8859-1")
    return files.withColumn("ok", (F.octet_length("content") >= min_bytes) & F.contains(start, F.lit(marker)))


#: Outputs shorter than this are taken for empty ones.
OUTPUT_BYTES = 100


def read_files(spark: SparkSession, path: str, marker: str, *, min_bytes: int = 8, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) files (path, length, content) under ``path``. Files that are too short are told by
    their length alone, so their content isn't read."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "length", "content")
    short = files.where(F.col("length") < min_bytes)
    marked = quarantine(files.where(F.col("length") >= min_bytes), marker, min_bytes)
    rejected = short.withColumn("why", F.lit("short")).unionByName(marked.where("NOT ok").drop("ok").withColumn("why", F.lit("marker")))
    return marked.where("ok").drop("ok"), rejected.select("path", "length", "why")


def write_rejects(rejected: DataFrame, path: str) -> None:
    """Append rejected files to a table by reason."""
    rejected.write.mode("append").partitionBy("why").parquet(path)


def check_outputs(files: DataFrame, marker: str) -> DataFrame:
    """``quarantine`` for files that were written: shorter ones than ``OUTPUT_BYTES`` aren't ok."""
    return quarantine(files, marker, OUTPUT_BYTES)


def build_manifest(docs: DataFrame, name: Column) -> DataFrame:
    """Name, size in bytes, number of pages (lines) and SHA-256 of each text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", name.alias("name"), F.octet_length(text).cast("long").alias("size_bytes"), F.size(F.split(text, "\n", -1)).cast("long").alias("pages"), F.sha2(text, 256).alias("sha256")
    )


def batch_run_report(rows: DataFrame, target: int) -> DataFrame:
    """Outcome of each file (id, before, after; a null or empty ``after`` failed): state, sizes, and the
    reduction in percent. Files within the target pass through unchanged."""
    through = F.col("before") <= target
    after = F.when(through, F.col("before")).otherwise(F.col("after"))
    state = F.when(F.coalesce(after, F.lit(0)) <= 0, "ERROR").otherwise("OK")
    reduction = F.when(state == "OK", F.round((F.col("before") - after) * 100.0 / F.col("before"), 1))
    return rows.select("doc_id", state.alias("state"), "before", F.when(state == "OK", after).alias("after"), reduction.alias("reduction"))


def write_batch_report(report: DataFrame, path: str) -> None:
    """The report as Parquet, in a folder for each state, so that failed files are found without a scan."""
    report.write.mode("overwrite").partitionBy("state").parquet(path)


def read_report_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``read_reports`` over files of JSON lines."""
    return read_reports(spark.read.text(path))


def read_reports(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, rejected lines): JSON lines (``value``) with the right schema tag, an id and both hashes."""
    rows = lines.withColumn("r", F.from_json("value", REPORT_SCHEMA, {"mode": "PERMISSIVE"}))
    ok = F.coalesce(
        (F.col("r.schema") == REPORT_TAG) & F.col("r.reportId").isNotNull() & F.col("r.reportSha256").isNotNull() & F.col("r.output.sha256").isNotNull(), F.lit(False)
    )
    return rows.where(ok).select(*[c for c in lines.columns if c != "value"], "r.*"), rows.where(~ok).select(*lines.columns)


def step_chain(docs: DataFrame) -> DataFrame:
    """One row per enabled step in order, with sizes before and after, from ``bytes``, ``enabled`` (step
    names) and ``factor`` (size kept by a step that shrinks). Each step starts from what the last left."""
    on = F.filter(F.array(*map(F.lit, STEPS)), lambda s: F.array_contains("enabled", s))
    rows = docs.select("doc_id", "bytes", "factor", F.posexplode(on).alias("ord", "step"))
    shrinks = F.col("step").isin("compress", "remove-metadata").cast("int")
    power = F.sum(shrinks).over(W.partitionBy("doc_id").orderBy("ord"))
    rows = rows.withColumn("after", F.floor(F.col("bytes") * F.pow(F.col("factor"), power)))
    rows = rows.withColumn("before", F.coalesce(F.lag("after").over(W.partitionBy("doc_id").orderBy("ord")), F.col("bytes")))
    change = (F.col("after") - F.col("before")) * 100.0 / F.col("before")
    text = (
        F.when(F.col("before") == 0, "0%").when(F.abs(change) < 0.05, "no change in size")
        .when(change < 0, F.concat(F.round(-change, 1).cast("string"), F.lit("% smaller"))).otherwise(F.concat(F.round(change, 1).cast("string"), F.lit("% larger")))
    )
    return rows.select("doc_id", (F.col("ord") + 1).alias("ord"), "step", "before", "after", text.alias("change"))


def validations(results: DataFrame) -> DataFrame:
    """(doc_id, key, status) of each check that applies to a prepared document: original_pages,
    removed_pages, final_pages, final_bytes, target_mb (null without a target), ocr, metadata, pdfa."""
    row = lambda key, status, on=None: F.when(F.lit(True) if on is None else on, F.struct(F.lit(key).alias("key"), status.alias("status")))
    flag = lambda ok: F.when(ok, "passed").otherwise("warning")
    limit = F.greatest(F.lit(0.1), F.col("target_mb")) * 1_048_576
    every = F.array_compact(
        F.array(
            row("structure", F.lit("passed")),
            row("page-integrity", flag(F.col("original_pages") - F.col("removed_pages") == F.col("final_pages"))),
            row("hashes", F.lit("passed")),
            row("target-size", flag(F.col("final_bytes") <= limit), F.col("target_mb").isNotNull()),
            row("ocr", F.lit("info"), F.col("ocr")),
            row("metadata", F.lit("info"), F.col("metadata")),
            row("pdfa", F.lit("info"), F.col("pdfa")),
            row("local-processing", F.lit("info")),
        )
    )
    return results.select("doc_id", F.inline(every))


def validation_rollup(checks: DataFrame) -> DataFrame:
    return checks.groupBy("doc_id").pivot("status", ["passed", "warning", "info"]).count().na.fill(0)


def issue_reports(manifest: DataFrame, issued: Column) -> DataFrame:
    """Reports of manifest rows: an id from the date and the output's hash, and the hash of the payload
    as JSON with sorted keys."""
    report_id = F.concat(F.lit("IR-"), F.date_format(issued, "yyyyMMdd"), F.lit("-"), F.upper(F.substring("sha256", 1, 12)))
    own = manifest.withColumn("report_id", report_id)
    output = F.struct(F.col("name"), F.col("pages"), F.col("sha256"), F.col("size_bytes").alias("sizeBytes")).alias("output")
    payload = F.to_json(F.struct(output, F.col("report_id").alias("reportId"), F.lit(REPORT_TAG).alias("schema")), {"ignoreNullFields": "false"})
    return own.withColumn("payload", payload).withColumn("report_sha256", F.sha2("payload", 256))


def verify_reports(reports: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per check of each report (doc_id, report_sha256, computed_sha256, sha256, size_bytes,
    pages) against the actual manifest: expected, actual, ok, and whether all of the report's are. Where
    the file is missing ``actual`` is null and the check fails; two nulls are equal."""
    a = actual.select("doc_id", F.col("sha256").alias("a_sha"), F.col("size_bytes").alias("a_size"), F.col("pages").alias("a_pages"))
    check = lambda key, expected, got: F.struct(
        F.lit(key).alias("key"), expected.cast("string").alias("expected"), got.cast("string").alias("actual"), F.lower(expected.cast("string")).eqNullSafe(F.lower(got.cast("string"))).alias("ok")
    )
    checks = F.array(
        check("report-sha256", F.col("report_sha256"), F.col("computed_sha256")),
        check("sha256", F.col("sha256"), F.col("a_sha")),
        check("size", F.col("size_bytes"), F.col("a_size")),
        check("pages", F.col("pages"), F.col("a_pages")),
    )
    rows = reports.join(a, "doc_id", "left").withColumn("checks", checks)
    return rows.select("doc_id", F.forall("checks", lambda c: c["ok"]).alias("matched"), F.inline("checks"))
