"""Queries about levels and admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom.operators import ledger as ops
from leafloom.plans import REGISTRY
from leafloom.sources.derived import table

NOW = "2024-01-15 00:00:00"
_PROFILES = "p_ AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'premium' ELSE 'free' END AS plan, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_days((c_custkey % 31)::INT) END AS premium_until FROM customer)"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def profiles(spark, sf_dir):
    k = F.col("c_custkey")
    until = F.when(k % 9 != 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + ops.days(k % 31))
    return table(spark, sf_dir, "customer").select(k.alias("user_id"), F.when(k % 3 == 0, "premium").otherwise("free").alias("plan"), until.alias("premium_until"))


@REGISTRY.add(
    "entitlement_check",
    f"""WITH {_PROFILES}, u_ AS (SELECT event_id, CASE WHEN event_id % 13 > 0 THEN user_id END AS user_id, event_type AS tool FROM events),
    l_ AS (SELECT u_.*, CASE WHEN u_.user_id IS NULL OR plan IS NULL THEN 'visitor' WHEN plan = 'premium' AND (premium_until IS NULL OR premium_until > TIMESTAMP '{NOW}') THEN 'premium' ELSE 'account' END AS level,
      CASE tool WHEN 'purchase' THEN 'premium' WHEN 'click' THEN 'account' ELSE 'visitor' END AS need FROM u_ LEFT JOIN p_ ON u_.user_id = p_.user_id)
    SELECT *, list_position(['visitor', 'account', 'premium'], level) >= list_position(['visitor', 'account', 'premium'], need) AS allowed FROM l_""",
)
def entitlement_check(spark, sf_dir):
    uses = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 13 > 0, F.col("user_id")).alias("user_id"), F.col("event_type").alias("tool"))
    need = spark.createDataFrame([("purchase", "premium"), ("click", "account")], "tool string, need string")
    return ops.entitlement_check(uses, profiles(spark, sf_dir), need, now())


@REGISTRY.add(
    "entitlement_as_of",
    """WITH s_ AS (SELECT user_id, ts, CASE WHEN event_id % 5 = 0 THEN 'free' ELSE 'premium' END AS plan, CASE WHEN event_id % 4 > 0 THEN ts + INTERVAL 1 DAY END AS premium_until, event_id FROM events WHERE event_type = 'purchase'),
    o_ AS (SELECT * FROM s_ QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1),
    a_ AS (SELECT event_id AS ask_id, user_id, ts FROM events WHERE event_type = 'view')
    SELECT ask_id, a_.user_id, coalesce(plan = 'premium' AND (premium_until IS NULL OR premium_until > a_.ts), false) AS premium FROM a_ ASOF LEFT JOIN o_ ON a_.user_id = o_.user_id AND a_.ts >= o_.ts""",
)
def entitlement_as_of(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    states = e.where("event_type = 'purchase'").select("user_id", "ts", F.when(k % 5 == 0, "free").otherwise("premium").alias("plan"), F.when(k % 4 > 0, F.col("ts") + ops.days(1)).alias("premium_until"), k.alias("state_id"))
    return ops.entitlement_as_of(states, e.where("event_type = 'view'").select("user_id", "ts", k.alias("ask_id")))


@REGISTRY.add(
    "charge_admission",
    """WITH a_ AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 200),
    c_ AS (SELECT 'c' || event_id AS charge_id, user_id, CASE WHEN event_id % 6 = 0 THEN user_id + 1 ELSE user_id END AS owner FROM events WHERE event_type = 'purchase'),
    w_ AS (SELECT c_.*, CASE WHEN a_.user_id IS NOT NULL THEN 'subscription' WHEN owner <> c_.user_id THEN 'owner' END AS why FROM c_ LEFT JOIN a_ ON c_.user_id = a_.user_id)
    SELECT *, why IS NULL AS admitted FROM w_""",
)
def charge_admission(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    charges = e.where("event_type = 'purchase'").select(F.concat(F.lit("c"), "event_id").alias("charge_id"), "user_id", F.when(F.col("event_id") % 6 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("owner"))
    return ops.charge_admission(charges, e.where("event_type = 'signup' AND value > 200"))


@REGISTRY.add(
    "pending_topk",
    f"""WITH p_ AS (SELECT event_id AS payment_id, user_id, ts, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_process' ELSE 'approved' END AS status, event_id % 5 = 0 AS applied FROM events WHERE event_type = 'click')
    SELECT payment_id, user_id, ts, status, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, payment_id DESC) AS pos FROM p_ WHERE status <> 'approved' AND NOT applied AND ts >= TIMESTAMP '{NOW}' - INTERVAL 2 DAY) WHERE pos <= 3""",
)
def pending_topk(spark, sf_dir):
    k = F.col("event_id")
    status = F.when(k % 3 == 0, "pending").when(k % 3 == 1, "in_process").otherwise("approved")
    pays = table(spark, sf_dir, "events").where("event_type = 'click'").select(k.alias("payment_id"), "user_id", "ts", status.alias("status"), (k % 5 == 0).alias("applied"))
    return ops.pending_topk(pays, now()).drop("applied")


@REGISTRY.add("create_profiles", f"WITH p_ AS (SELECT user_id, min(ts) AS created FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT * FROM p_")
def create_profiles(spark, sf_dir):
    """One profile for each user at the first sign-up, put into a table that is empty at first; the streaming form
    is in leafloom.streaming."""
    signups = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", F.col("ts").alias("created"))
    return ops.insert_ignore(signups.limit(0), signups, "user_id", ["created"])
