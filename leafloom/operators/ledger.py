"""Entitlements from payment events: levels, notices, credits that apply once, expiring charges.

The batch forms are windows and folds by user or payment. The streaming forms of the same rules are in
``leafloom.streaming.ledger``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafloom.functions.text import hmac_sha256
from leafloom.operators.ordering import running_sum

# Prices and days of a period, levels in order, days of grace, minutes a charge lives.
PERIODS = {"month": ("19.90", 30), "year": ("199.00", 365)}
LEVELS = ["visitor", "account", "premium"]
GRACE_DAYS, OPEN_DAYS, CHARGE_MINUTES = 3, 31, 60


def rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level)


def days(n: Column | int) -> Column:
    return F.make_dt_interval(days=F.lit(n) if isinstance(n, int) else n.cast("int"))


def entitlement_check(uses: DataFrame, profiles: DataFrame, required: DataFrame, now: Column) -> DataFrame:
    """Uses (user_id or null, tool) with the user's ``level``, the tool's ``need`` (visitor if none is
    stated; a small table) and ``allowed``. A premium plan without an end has no deadline."""
    premium = (F.col("plan") == "premium") & (F.col("premium_until").isNull() | (F.col("premium_until") > now))
    level = F.when(F.col("user_id").isNull() | F.col("plan").isNull(), "visitor").when(premium, "premium").otherwise("account")
    rows = uses.join(profiles, "user_id", "left").join(required, "tool", "left")
    rows = rows.withColumn("level", level).withColumn("need", F.coalesce("need", F.lit("visitor")))
    return rows.withColumn("allowed", rank(F.col("level")) >= rank(F.col("need"))).drop("plan", "premium_until")


def entitlement_as_of(states: DataFrame, asks: DataFrame) -> DataFrame:
    """Whether each ask (user_id, ts, ask_id) finds the user premium: the last state (user_id, ts, plan,
    premium_until, state_id) at or before it, strict at the end of a period. States and asks are
    merged and walked by user in order of time."""
    s = states.select("user_id", "ts", F.struct("plan", "premium_until").alias("state"), F.col("state_id").alias("tie"), F.lit(None).cast("bigint").alias("ask_id"))
    a = asks.select("user_id", "ts", F.lit(None).cast(s.schema["state"].dataType).alias("state"), F.lit(2**62).alias("tie"), "ask_id")
    order = W.partitionBy("user_id").orderBy("ts", "tie")
    both = s.unionByName(a).withColumn("last", F.last("state", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    until = F.col("last.premium_until")
    premium = F.coalesce((F.col("last.plan") == "premium") & (until.isNull() | (until > F.col("ts"))), F.lit(False))
    return both.where("ask_id IS NOT NULL").select("ask_id", "user_id", premium.alias("premium"))


def charge_admission(charges: DataFrame, authorized: DataFrame) -> DataFrame:
    """New charges (charge_id, user_id, owner): rejected if the user has an authorized subscription, or
    if the charge belongs to another user."""
    held = authorized.select("user_id").distinct().withColumn("held", F.lit(True))
    rows = charges.join(held, "user_id", "left")
    why = F.when(F.col("held"), "subscription").when(~F.col("owner").eqNullSafe(F.col("user_id")), "owner")
    return rows.withColumn("why", why).withColumn("admitted", F.col("why").isNull()).drop("held")


def pending_topk(payments: DataFrame, now: Column, back_days: int = 2, keep: int = 3) -> DataFrame:
    """Of each user's payments that wait and aren't applied, the newest of the last days."""
    rows = payments.where(F.col("status").isin("pending", "in_process") & ~F.col("applied") & (F.col("ts") >= now - days(back_days)))
    return rows.withColumn("pos", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("payment_id")))).where(F.col("pos") <= keep)


def verify_signatures(notices: DataFrame, secret: str) -> DataFrame:
    """Notices (data_id, request_id, header "ts=..,v1=..") with ``valid``. Ids of letters and digits
    count in lower case; a missing header or secret is never valid. The secret is a parameter of the
    caller; don't print the plan."""
    parts = F.transform(F.split("header", ","), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_replace(p, r"^[^=]*=?", "")).alias("v")))
    part = lambda name: F.try_element_at(F.transform(F.filter(parts, lambda p: p["k"] == name), lambda p: p["v"]), F.lit(-1))
    data_id = F.when(F.col("data_id").rlike("(?i)^[a-z0-9]+$"), F.lower("data_id")).otherwise(F.col("data_id"))
    own = notices.withColumns({"__ts": part("ts"), "__v1": part("v1")})
    request = F.when(F.coalesce("request_id", F.lit("")) != "", F.concat(F.lit("request-id:"), "request_id", F.lit(";"))).otherwise(F.lit(""))
    message = F.concat(F.lit("id:"), data_id, F.lit(";"), request, F.lit("ts:"), "__ts", F.lit(";"))
    ok = (F.col("__ts") != "") & (F.col("__v1") != "") & (F.lower("__v1") == hmac_sha256(secret, message)) if secret else F.lit(False)
    return own.withColumn("valid", F.coalesce(ok, F.lit(False))).drop("__ts", "__v1")


def route_events(events: DataFrame) -> DataFrame:
    """``route`` of notices with the fields type, topic, data_id and id."""
    kind, id_ = F.coalesce("type", "topic", F.lit("")), F.coalesce("data_id", "id", F.lit(""))
    route = (
        F.when(id_ == "", "no id").when(kind == "payment", "payment").when(kind.isin("subscription_preapproval", "preapproval"), "preapproval")
        .when(kind.isin("subscription_authorized_payment", "authorized_payment"), "authorized_payment").when(kind == "", "unknown").otherwise("ignored")
    )
    return events.withColumn("route", route)


def approved_purchases(payments: DataFrame, prefix: str) -> DataFrame:
    """Approved payments (status, reference, currency, amount) of a known period at its price or more:
    the reference names period and user."""
    pattern = rf"(?i)^{prefix}:(month|year):([0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}})$"
    period, user = F.lower(F.regexp_extract("reference", pattern, 1)), F.lower(F.regexp_extract("reference", pattern, 2))
    price = F.when(F.col("period") == "month", F.lit(PERIODS["month"][0])).when(F.col("period") == "year", F.lit(PERIODS["year"][0])).cast("decimal(10,2)")
    rows = payments.where((F.col("status") == "approved") & F.coalesce(F.col("currency") == "BRL", F.lit(True))).withColumns({"period": period, "owner": user})
    return rows.where((F.col("period") != "") & (F.col("amount") >= price))


def apply_once(payments: DataFrame) -> DataFrame:
    """The first approved notice of each payment; later ones, of whatever status, change nothing. Of several
    at one time the least by user and period, and then by all else."""
    ties = [c for c in ("ts", "user_id", "period") if c in payments.columns]
    ties += sorted(c for c in payments.columns if c not in (*ties, "payment_id", "status"))
    first = F.row_number().over(W.partitionBy("payment_id").orderBy(*ties))
    return payments.where("status = 'approved'").withColumn("n", first).where("n = 1").drop("n")


def premium_ledger(credits: DataFrame, initial: DataFrame | None = None, *, keep_unlimited: bool = False) -> DataFrame:
    """The end of premium after each credit (user_id, ts, payment_id, period): each adds its days to the
    later of its own time and the end so far. ``initial`` (user_id, plan, premium_until) has what users
    start with; an end counts for users whose plan is premium. Premium without an end starts anew with
    the first credit, or with ``keep_unlimited`` stays without an end.

    Closed form: with S the running sum of days, the end after the k-th credit is S_k plus the
    largest of t_j - S_(j-1) for j up to k, and of the initial end.
    """
    length = F.when(F.col("period") == "month", PERIODS["month"][1]).otherwise(PERIODS["year"][1]).cast("long") * 86_400_000_000
    order = W.partitionBy("user_id").orderBy("ts", "payment_id").rowsBetween(W.unboundedPreceding, 0)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = credits.withColumn("len", length).withColumn("sum", F.sum("len").over(order)).withColumn("lead", F.max(at - (F.col("sum") - F.col("len"))).over(order))
    end = lambda lead: F.timestamp_micros(F.col("sum") + lead).cast("timestamp_ntz")
    if initial is None:
        return rows.withColumn("premium_until", end(F.col("lead"))).drop("len", "sum", "lead")
    held = initial.where("plan = 'premium'").select("user_id", F.unix_micros(F.col("premium_until").cast("timestamp")).alias("held"), F.col("premium_until").isNull().alias("unlimited"))
    rows = rows.join(held, "user_id", "left").withColumn("premium_until", end(F.greatest("lead", "held")))  # greatest passes over nulls
    if keep_unlimited:
        rows = rows.withColumn("premium_until", F.when(F.coalesce("unlimited", F.lit(False)), None).otherwise(F.col("premium_until")))
    return rows.drop("len", "sum", "lead", "held", "unlimited")


def subscription_state(events: DataFrame) -> DataFrame:
    """By user the latest status, and the latest end of premium that an authorized event (status,
    price_ok, next_ts or null, ts) gives: the later of next charge and event, or 31 days on without a
    date, and 3 days of grace. A shorter end never replaces a longer one."""
    base = F.when(F.col("next_ts").isNotNull(), F.greatest("next_ts", "ts")).otherwise(F.col("ts") + days(OPEN_DAYS))
    until = F.when((F.col("status") == "authorized") & F.col("price_ok"), base + days(GRACE_DAYS))
    return events.groupBy("user_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max(until).alias("premium_until"))


def expire_charges(charges: DataFrame, approvals: DataFrame, minutes: int = CHARGE_MINUTES) -> DataFrame:
    """Charges (charge_id, user_id, ts): ``paid`` by an approval of the user within the minutes after it,
    the first of them, or expired. Both are cut into spans of so many minutes, and a charge is held against
    its own span and the next: a user's charges never meet all of that user's approvals."""
    at, width = F.unix_micros(F.col("ts").cast("timestamp")), minutes * 60_000_000
    span = F.floor(at / width)
    a = charges.select("charge_id", "user_id", "ts", F.explode(F.array(span, span + 1)).alias("span"))
    b = approvals.select(F.col("user_id").alias("u"), F.col("ts").alias("paid_ts"), span.alias("s")).distinct()
    within = (F.col("user_id") == F.col("u")) & (F.col("span") == F.col("s")) & (F.col("paid_ts") >= F.col("ts")) & (F.col("paid_ts") <= F.col("ts") + F.make_dt_interval(mins=F.lit(minutes)))
    rows = a.join(b, within, "left").groupBy("charge_id", "user_id", "ts").agg(F.min("paid_ts").alias("paid_ts"))
    return rows.withColumn("status", F.when(F.col("paid_ts").isNotNull(), "paid").otherwise("expired"))


def insert_ignore(table: DataFrame, rows: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """The table with the rows whose key it hasn't; of rows that share a key the first by ``order``, or by
    all columns where none is named. Rows without a key aren't inserted."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*table.columns), F.struct(*(order or rows.columns))).alias("r")).select("r.*")
    return table.unionByName(first.join(table.select(key), key, "left_anti"))


def registry_upsert(registry: DataFrame, rows: DataFrame, key: str = "id", last: DataFrame | None = None) -> DataFrame:
    """Entries (key, ord, built_in, ..) with those of ``rows`` put in place of old ones and at the end, in
    their order; built-in rows are never stored. New entries are numbered by ranges. ``last`` (one row) has the
    last number where ``registry`` is a part of a table."""
    new = rows.where("NOT built_in")
    old = registry.join(new.select(key), key, "left_anti")
    last = registry.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("last")) if last is None else last
    numbered = running_sum(new.select("*", F.lit(0).alias("all"), F.lit(1).alias("one"), F.struct("ord", key).alias("place")), ["all"], "place", "one")
    placed = numbered.join(last).withColumn("ord", F.col("last") + F.col("before") + 1)  # one row
    return old.unionByName(placed.select(*registry.columns))


def touch_registry(registry: DataFrame, uses: DataFrame, key: str = "id") -> DataFrame:
    """Entries with ``last_used``: the latest use (key, ts) that is on record, or what they had."""
    latest = uses.groupBy(key).agg(F.max("ts").alias("used"))
    return registry.join(latest, key, "left").withColumn("last_used", F.greatest("last_used", "used")).select(*registry.columns)


def read_registry(lines: DataFrame, fields: str) -> tuple[DataFrame, DataFrame]:
    """(entries, rejected lines) of JSON objects (``value``) that must hold a string id and settings."""
    rows = lines.withColumn("r", F.from_json("value", f"{fields}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    ok = F.coalesce(F.col("r._corrupt").isNull() & F.col("r.id").isNotNull() & F.col("r.settings").isNotNull(), F.lit(False))
    own = [c for c in lines.columns if c != "value"]
    return rows.where(ok).select(*own, "r.id", "r.settings"), rows.where(~ok).select(*lines.columns)


def read_registry_files(spark: SparkSession, path: str, fields: str) -> tuple[DataFrame, DataFrame]:
    """``read_registry`` over files of JSON lines."""
    return read_registry(spark.read.text(path), fields)


def read_registry_arrays(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, rejected files) of whole files (``value``), each of which has to be one JSON array. A file that is
    none, or isn't JSON, gives no entries; of an array, entries without a string ``id`` or without ``settings``
    (null, false, 0 and "" count as none) are left out. ``entry`` numbers them from 1 as they stand in the file;
    ``settings`` is a variant."""
    own = [c for c in files.columns if c != "value"]
    items = F.try_parse_json("value").try_cast("array<variant>")
    is_array = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("ARRAY"), F.lit(False))
    marked = files.withColumns({"is_array": is_array, "items": items})
    each = marked.where("is_array").select(*own, F.posexplode("items").alias("at", "item"))
    told = each.select(*own, (F.col("at") + 1).alias("entry"), F.try_variant_get("item", "$.id", "variant").alias("id"), F.try_variant_get("item", "$.settings", "variant").alias("settings"))
    empty = F.is_variant_null("settings") | F.to_json("settings").isin("false", "0", '""')
    good = told.where((F.schema_of_variant("id") == "STRING") & F.col("settings").isNotNull() & ~empty)
    return good.select(*own, "entry", F.try_variant_get("id", "$", "string").alias("id"), "settings"), marked.where("NOT is_array").select(*files.columns)


def read_registry_array_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``read_registry_arrays`` over files, each read whole, with the ``file`` that an entry is from."""
    return read_registry_arrays(spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name()))
