"""Rule jobs: search, categories, constraints, quotas, candidates, audits, sequences of use."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafloom.functions.text import strip_accents

# The patterns of an id and of an address.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def fold(text: Column) -> Column:
    """Lower case without accents; plain ASCII texts take the short way."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.lower(strip_accents(text))).otherwise(F.lower(text))


def facet_search(items: DataFrame, ranks: DataFrame, facet: str | None, needle: str, fields: list[str], collation: str | None = None) -> DataFrame:
    """Items of the facet (all, if None) whose fields hold the needle, case and accents aside, by rank
    (999 for items without one). ``ranks`` is a small table (id, rank). Accents are taken off by decomposition;
    with a ``collation`` such as UNICODE_CI_AI its rules hold, by which ss is found in a sharp s and ae in its
    ligature."""
    text = F.concat_ws(" ", *fields)
    met = F.contains(fold(text), fold(F.lit(needle))) if collation is None else F.contains(F.collate(text, collation), F.collate(F.lit(needle), collation))
    own = items.where(met)
    own = own if facet is None else own.where(F.col("category") == facet)
    return own.join(ranks, "id", "left").withColumn("rank", F.coalesce("rank", F.lit(999)))


def categorize(rows: DataFrame, name: str, rules: list[tuple[str, str]]) -> DataFrame:
    """``category`` of the first rule (pattern, category) that matches the folded name, or ''."""
    out = F.lit("")
    for pattern, category in reversed(rules):
        out = F.when(fold(F.col(name)).rlike(pattern), category).otherwise(out)
    return rows.withColumn("category", out)


def category_dictionary(names: DataFrame, removed: list[str], longest: int = 60) -> DataFrame:
    """Names (ord, name) to dictionary entries: trimmed, spaces collapsed, cut; of spellings that differ
    in case the first stays; entries that were removed are blank."""
    clean = F.substring(F.trim(F.regexp_replace("name", r"\s+", " ")), 1, longest)
    own = names.withColumn("name", clean).where("name <> ''").groupBy(F.lower("name").alias("key")).agg(F.min_by("name", "ord").alias("name"), F.count(F.lit(1)).alias("n"))
    return own.withColumn("shown", F.when(F.col("key").isin([r.lower() for r in removed]), "").otherwise(F.col("name")))


def valid_identity(rows: DataFrame) -> DataFrame:
    """Rows (uid, email) with ``uuid_ok`` and ``email_ok``."""
    return rows.withColumns({"uuid_ok": F.col("uid").rlike(UUID), "email_ok": F.col("email").rlike(EMAIL) & (F.length("email") <= 254)})


def preset_compliance(docs: DataFrame, presets: list[tuple[str, float]]) -> DataFrame:
    """Every document (doc_id, bytes) against every size preset (name, target in MB), a stated list that is
    laid beside each row: ``passes``, and by document the tightest preset that it passes."""
    listed = F.array(*(F.struct(F.lit(name).alias("preset"), F.lit(float(mb)).alias("target_mb")) for name, mb in presets))
    fits = lambda p: F.col("bytes") <= F.greatest(F.lit(0.1), p["target_mb"]) * 1_048_576
    passed = F.transform(F.filter(listed, fits), lambda p: F.struct(p["target_mb"], p["preset"]))
    rows = docs.select("*", F.array_min(passed)["preset"].alias("tightest"), F.explode(listed).alias("own"))
    return rows.select(*docs.columns, "own.preset", "own.target_mb", fits(F.col("own")).alias("passes"), "tightest")


def allowlist(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return rows.where(F.col(column).isin(allowed))


def violations(tables: dict[str, DataFrame], enums: list[tuple[str, str, list[str]]], required: list[tuple[str, str]], unique: list[tuple[str, str]], foreign: list[tuple[str, str, str, str]]) -> DataFrame:
    """(rule, key, n) of rows that break a constraint: values outside a list, nulls, values that repeat
    (nulls aside), and references without a target.

    Each table is read once: a row gives what it breaks, and for unique and foreign keys the value that it
    holds or refers to; all of that is counted by rule and value in one shuffle, combined before it."""
    parts = []
    for name, rows in tables.items():
        say = lambda rule, key, kind, when: F.when(when, F.struct(F.lit(rule).alias("rule"), key.cast("string").alias("key"), F.lit(kind).alias("kind")))
        none = F.lit(None).cast("string")
        told = [
            *(say(f"enum {t}.{c}", F.col(c), "broken", ~F.col(c).isin(v)) for t, c, v in enums if t == name),
            *(say(f"null {t}.{c}", none, "broken", F.col(c).isNull()) for t, c in required if t == name),
            *(say(f"unique {t}.{c}", F.col(c), "held", F.col(c).isNotNull()) for t, c in unique if t == name),
            *(say(f"foreign {t}.{c}", F.col(c), "refers", F.col(c).isNotNull()) for t, c, _, _ in foreign if t == name),
            *(say(f"foreign {t}.{c}", F.col(k), "target", F.col(k).isNotNull()) for t, c, p, k in foreign if p == name),
        ]
        if told:
            parts.append(rows.select(F.explode(F.array_compact(F.array(*told))).alias("x")).select("x.*"))
    every = functools.reduce(DataFrame.unionByName, parts)
    count = lambda kind: F.count_if(F.col("kind") == kind)
    n = F.when(F.col("broken") > 0, F.col("broken")).when(F.col("held") > 1, F.lit(1)).when((F.col("refers") > 0) & (F.col("target") == 0), F.col("refers"))
    counted = every.groupBy("rule", "key").agg(*(count(k).alias(k) for k in ("broken", "held", "refers", "target")))
    return counted.select("rule", "key", n.cast("long").alias("n")).where("n IS NOT NULL")


def cascade_delete(children: DataFrame, child_key: str, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted.select(F.col(key).alias(child_key)), child_key, "left_anti")


def row_level_view(rows: DataFrame, owner: str, principal: int | None) -> DataFrame:
    """Only the principal's own rows; none for an anonymous one."""
    return rows.where(F.col(owner) == principal) if principal is not None else rows.where(F.lit(False))


def quota_check(use: DataFrame, limits: DataFrame) -> DataFrame:
    """Uses (level, files, ocr_pages, mode) against the limits of their level (null: no limit): ``blocked``
    and the reason."""
    rows = use.join(limits, "level", "left")
    reason = (
        F.when(F.col("files") > F.col("max_files"), "files").when(F.col("ocr_pages") > F.col("max_ocr_pages"), "ocr")
        .when(F.array_contains("blocked_modes", F.col("mode")), "mode")
    )
    return rows.withColumn("reason", reason).withColumn("blocked", F.col("reason").isNotNull())


def select_candidate(rows: DataFrame) -> DataFrame:
    """By key, candidates (rank, size) tried in order against ``original`` and ``target``: the chosen
    rank (null keeps the original), its size, how many were tried, and the log of attempts.

    Trying stops at the first candidate within the target; without one, the smallest wins if it is
    smaller than the original.
    """
    key = W.partitionBy("key")
    tried = rows.withColumn("stop", F.min(F.when(F.col("size") <= F.col("target"), F.col("rank"))).over(key)).where("stop IS NULL OR rank <= stop")
    best = F.min(F.when(F.col("size") < F.col("original"), F.struct("size", "rank")))
    log = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "size"))), lambda x: F.concat(x["rank"].cast("string"), F.lit(":"), x["size"].cast("string"))), " ")
    return tried.groupBy("key").agg(
        best.alias("b"), F.count(F.lit(1)).alias("tried"), log.alias("log"), (F.max("stop").isNotNull()).alias("met"), F.first("original").alias("original")
    ).select("key", F.col("b.rank").alias("rank"), F.coalesce("b.size", "original").alias("size"), "tried", "met", "log")


def accept_rewrites(items: DataFrame) -> DataFrame:
    """Rewrites of items (kind, old_size, new_size, pixels, limit) by group: how many, how many taken
    and skipped, how many scaled down, and bytes saved. A rewrite is taken if its kind can be rewritten
    and it saves 8 % or more; it scales down if over 1.2 times the limit."""
    eligible = F.col("kind").isin("STANDARD", "PROMO", "ECONOMY")
    take = eligible & (F.col("new_size") < 0.92 * F.col("old_size"))
    return items.groupBy("grp").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(take).alias("taken"), F.count_if(~take).alias("skipped"),
        F.count_if(take & (F.col("pixels") > 1.2 * F.col("limit"))).alias("scaled"), F.coalesce(F.sum(F.when(take, F.col("old_size") - F.col("new_size"))), F.lit(0)).cast("long").alias("saved"),
    )


def object_audit(objects: DataFrame, version: int, cap: int = 5) -> DataFrame:
    """By document, objects (font, embedded, transparent, cmyk, attachment): fonts that aren't embedded
    (the first ``cap``), what else it holds, and the warnings for an archive version."""
    fonts = F.array_sort(F.collect_set(F.when(~F.col("embedded"), F.col("font"))))
    own = objects.groupBy("doc").agg(fonts.alias("f"), F.bool_or("transparent").alias("transparent"), F.bool_or("cmyk").alias("cmyk"), F.bool_or("attachment").alias("attachment"))
    say = lambda on, text: F.when(on, F.lit(text))
    warnings = F.array_compact(
        F.array(
            say(F.size("f") > 0, "fonts not embedded"), say(F.col("transparent") & F.lit(version == 1), "transparency"), say(F.col("cmyk"), "cmyk without profile"), say(F.col("attachment") & F.lit(version != 3), "attachments removed")
        )
    )
    shown = F.concat(F.array_join(F.slice("f", 1, cap), ", "), F.when(F.size("f") > cap, "...").otherwise(""))
    return own.select("doc", shown.alias("fonts"), F.size("f").alias("n_fonts"), F.array_join(warnings, "; ").alias("warnings"))


def asset_inventory(assets: DataFrame, least: float) -> DataFrame:
    """Assets (doc, page, pos, ref, width, height) with both sides of ``least`` or more: the first one of
    each reference, numbered in its page by appearance. A document of which none is left gives one row with an
    ``error`` instead; it is null in all others."""
    ref = F.coalesce("ref", F.concat_ws(":", "page", "pos"))
    big = assets.where((F.col("width") >= least) & (F.col("height") >= least)).withColumn("ref", ref)
    first = big.withColumn("seen", F.row_number().over(W.partitionBy("doc", "ref").orderBy("page", "pos", "width", "height"))).where("seen = 1").drop("seen")
    numbered = first.withColumn("number", F.row_number().over(W.partitionBy("doc", "page").orderBy("pos", "width", "height"))).withColumn("error", F.lit(None).cast("string"))
    kept = F.coalesce((F.col("width") >= least) & (F.col("height") >= least), F.lit(False))
    bare = assets.groupBy("doc").agg(F.count_if(kept).alias("kept")).where("kept = 0").select("doc", F.lit("no image").alias("error"))
    return numbered.unionByName(bare, allowMissingColumns=True)


def dominant_bucket(rows: DataFrame, shift: int = 3) -> DataFrame:
    """By key the most frequent value in steps of 2**shift (ties: first seen), how often it is met, and
    the first raw value in it; rows are (key, pos, value)."""
    buckets = rows.groupBy("key", F.shiftright(F.col("value").cast("int"), shift).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.min_by("value", "pos").alias("value"))
    best = F.max_by(F.struct("bucket", "n", "value"), F.struct("n", (-F.col("first")).alias("f")))
    return buckets.groupBy("key").agg(best.alias("b")).select("key", "b.*")


def array_change_ratio(pairs: DataFrame, threshold: float, stride: int = 1) -> DataFrame:
    """Percentage of sampled places at which arrays ``a`` and ``b`` differ by more than the threshold
    (100 for different lengths), and the label that follows from it. Of two empty arrays nothing differs; a
    missing array is an empty one."""
    pairs = pairs.withColumns({c: F.coalesce(F.col(c), F.array().cast(pairs.schema[c].dataType)) for c in ("a", "b")})
    at = F.when(F.size("a") > 0, F.sequence(F.lit(0), F.size("a") - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    far = F.filter(at, lambda i: F.abs(F.get("a", i) - F.get("b", i)) > threshold)
    ratio = F.when(F.size("a") != F.size("b"), 100.0).otherwise(F.size(far) * 100.0 / F.greatest(F.size(at), F.lit(1)))
    return pairs.withColumn("ratio", ratio).withColumn("status", F.when(F.col("ratio") >= 0.8, "modified").otherwise("unchanged")).drop("a", "b")


def upper_median_gap(rows: DataFrame, slack: float) -> DataFrame:
    """By key (ts in seconds, ordered with id): gaps, the upper median gap, and how many splits there
    are where a gap is over it by more than ``slack``."""
    order = W.partitionBy("key").orderBy("ts", "id")
    gaps = rows.withColumn("gap", F.col("ts") - F.lag("ts").over(order)).where("gap IS NOT NULL")
    # Gaps are counted by size, so the middle one is found on sorted rows and no key's gaps meet in an array.
    counts = gaps.groupBy("key", "gap").agg(F.count(F.lit(1)).alias("n"))
    key = W.partitionBy("key")
    counts = counts.withColumns({"upto": F.sum("n").over(key.orderBy("gap")), "gaps": F.sum("n").over(key)})
    counts = counts.withColumn("median", F.min(F.when(F.col("upto") > F.floor(F.col("gaps") / 2), F.col("gap"))).over(key))
    return counts.groupBy("key", "median", "gaps").agg(F.coalesce(F.sum(F.when(F.col("gap") > F.col("median") + slack, F.col("n"))), F.lit(0)).alias("splits"))


def recent_items(uses: DataFrame, keep: int = 8) -> DataFrame:
    """The latest distinct items of each user, newest first."""
    last = uses.groupBy("user_id", "item").agg(F.max(F.struct("ts", "id")).alias("last"))
    ranked = last.withColumn("pos", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("last"))))
    return ranked.where(F.col("pos") <= keep).select("user_id", "pos", "item")


def _fold_favorites(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, held, begun = None, [], False  # a user may go on in the next batch
        for batch in batches:
            done, kind = [], batch.schema.field("user_id").type
            for u, item in zip(batch.column("user_id").to_pylist(), batch.column("item").to_pylist()):
                if not begun or u != user:
                    if begun:
                        done.append((user, held))
                    user, held, begun = u, [], True
                held = [x for x in held if x != item] if item in held else [item, *held][:keep]
            yield out(done, kind)
        if begun:
            yield out([(user, held)], kind)

    def out(done: list[tuple[int | str, list[int | str]]], kind: pa.DataType) -> pa.RecordBatch:
        cols = [pa.array([u for u, _ in done], kind), pa.array([",".join(map(str, h)) for _, h in done], pa.string()), pa.array([len(h) for _, h in done], pa.int32())]
        return pa.RecordBatch.from_arrays(cols, ["user_id", "favorites", "n"])

    return run


def favorites_fold(toggles: DataFrame, keep: int = 12) -> DataFrame:
    """Favourites of each user after all toggles (user_id, item: numbers or texts) in order: a held item is taken
    out, another one goes in front and what is beyond ``keep`` falls off. Toggles are walked in order of
    (ts, id) with ``keep`` items in memory, however long a user's history is; those without an item are
    left out."""
    own = toggles.where("item IS NOT NULL").select("user_id", "item", "ts", "id")
    ordered = own.repartition("user_id").sortWithinPartitions("user_id", "ts", "id").select("user_id", "item")
    return ordered.mapInArrow(_fold_favorites(keep), f"user_id {dict(own.dtypes)['user_id']}, favorites string, n int")
