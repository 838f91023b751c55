"""Queries about payment notices and the premium they give."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom.functions.text import hmac_sha256
from leafloom.operators import ledger as ops
from leafloom.plans import REGISTRY
from leafloom.plans.entitlements import _PROFILES, profiles
from leafloom.plans.sql import PAYMENTS
from leafloom.sources.derived import payments, table

#: A key for signing test notices; real keys come from the caller's configuration.
DEMO_SECRET = "demo-signing-key"


@REGISTRY.add("verify_signatures", "SELECT event_id, NOT (event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0) AS valid FROM events")
def verify_signatures(spark, sf_dir):
    """Notices signed by rule: every 7th has a wrong hash, every 11th no header, every 13th another id."""
    e = F.col("event_id")
    data_id = F.when(e % 2 == 0, F.concat(F.lit("PAY"), e)).otherwise(F.concat(F.lit("pay-"), e))
    request = F.when(e % 3 > 0, F.concat(F.lit("r"), e))
    signed = F.when(e % 2 == 0, F.lower(data_id)).otherwise(data_id)
    message = F.concat(F.lit("id:"), signed, F.lit(";"), F.when(request.isNotNull(), F.concat(F.lit("request-id:"), request, F.lit(";"))).otherwise(F.lit("")), F.lit("ts:1700;"))
    v1 = F.when(e % 7 == 0, F.lit("00")).otherwise(F.upper(hmac_sha256(DEMO_SECRET, message)))
    notices = table(spark, sf_dir, "events").select(
        e, F.when(e % 13 == 0, F.concat(data_id, F.lit("x"))).otherwise(data_id).alias("data_id"), request.alias("request_id"), F.when(e % 11 > 0, F.concat(F.lit("ts=1700, v1="), v1)).alias("header")
    )
    return ops.verify_signatures(notices, DEMO_SECRET).select("event_id", "valid")


@REGISTRY.add(
    "route_events",
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'no id' WHEN event_type = 'purchase' THEN 'payment' WHEN event_type = 'signup' THEN 'preapproval' WHEN event_type = 'click' THEN 'authorized_payment' WHEN event_type = 'error' THEN 'unknown' ELSE 'ignored' END AS route FROM events""",
)
def route_events(spark, sf_dir):
    kind = F.col("event_type")
    type_ = F.when(kind == "purchase", "payment").when(kind == "signup", "subscription_preapproval").when(kind == "view", "view")
    rows = table(spark, sf_dir, "events").select("event_id", type_.alias("type"), F.when(kind == "click", "authorized_payment").alias("topic"), F.when((F.col("event_id") % 10 > 0) & (F.col("event_id") % 2 == 0), F.col("event_id").cast("string")).alias("data_id"), F.when((F.col("event_id") % 10 > 0) & (F.col("event_id") % 2 == 1), F.col("event_id").cast("string")).alias("id"))
    return ops.route_events(rows).select("event_id", "route")


@REGISTRY.add(
    "approved_purchases",
    f"""WITH {PAYMENTS}, h_ AS (SELECT *, md5(user_id::VARCHAR) AS h FROM pay_),
    r_ AS (SELECT payment_id, ts, period, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS owner, status, amount, user_id FROM h_)
    SELECT payment_id, ts, period, owner FROM r_ WHERE status = 'approved' AND user_id % 10 > 0 AND user_id % 7 > 0 AND user_id % 11 > 0""",
)
def approved_purchases(spark, sf_dir):
    """References name period and user; those of some users are broken, in another currency or short of the price."""
    u, h = F.col("user_id"), F.md5(F.col("user_id").cast("string"))
    uid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    rows = payments(spark, sf_dir).withColumn("reference", F.concat(F.lit("Shop-Pix:"), F.upper("period"), F.lit(":"), F.when(u % 10 == 0, F.lit("nobody")).otherwise(F.upper(uid))))
    rows = rows.withColumn("currency", F.when(u % 7 == 0, "USD").when(u % 2 == 0, "BRL")).withColumn("amount", F.when(u % 11 == 0, F.col("amount") - F.lit("0.01").cast("decimal(10,2)")).otherwise(F.col("amount")))
    return ops.approved_purchases(rows, "shop-pix").select("payment_id", "ts", "period", "owner")


_ONCE = f"{PAYMENTS}, once_ AS (SELECT * FROM pay_ WHERE status = 'approved' QUALIFY row_number() OVER (PARTITION BY payment_id ORDER BY ts, user_id, period, amount) = 1)"


@REGISTRY.add("apply_once", f"WITH {_ONCE} SELECT * FROM once_")
def apply_once(spark, sf_dir):
    return ops.apply_once(payments(spark, sf_dir))


@REGISTRY.add(
    "premium_ledger",
    f"""WITH {_ONCE}, l_ AS (SELECT *, CASE period WHEN 'month' THEN 30 ELSE 365 END * 86400000000 AS len FROM once_),
    s_ AS (SELECT *, sum(len) OVER w AS total FROM l_ WINDOW w AS (PARTITION BY user_id ORDER BY ts, payment_id ROWS UNBOUNDED PRECEDING)),
    m_ AS (SELECT *, max(epoch_us(ts) - (total - len)) OVER w AS lead FROM s_ WINDOW w AS (PARTITION BY user_id ORDER BY ts, payment_id ROWS UNBOUNDED PRECEDING))
    SELECT payment_id, user_id, make_timestamp((total + lead)::BIGINT) AS premium_until FROM m_""",
)
def premium_ledger(spark, sf_dir):
    return ops.premium_ledger(ops.apply_once(payments(spark, sf_dir))).select("payment_id", "user_id", "premium_until")


def _from_initial(unlimited: str) -> str:
    """Ends of premium of users who start with what their profile says."""
    return f"""WITH {_ONCE}, {_PROFILES}, l_ AS (SELECT o.*, CASE period WHEN 'month' THEN 30 ELSE 365 END * 86400000000 AS len, epoch_us(CASE WHEN plan = 'premium' THEN premium_until END) AS held,
      coalesce(plan = 'premium' AND premium_until IS NULL, false) AS unlimited FROM once_ o LEFT JOIN p_ USING (user_id)),
    s_ AS (SELECT *, sum(len) OVER w AS total FROM l_ WINDOW w AS (PARTITION BY user_id ORDER BY ts, payment_id ROWS UNBOUNDED PRECEDING)),
    m_ AS (SELECT *, max(greatest(epoch_us(ts) - (total - len), held)) OVER w AS lead FROM s_ WINDOW w AS (PARTITION BY user_id ORDER BY ts, payment_id ROWS UNBOUNDED PRECEDING))
    SELECT payment_id, user_id, {unlimited} AS premium_until FROM m_"""


@REGISTRY.add("premium_ledger_from", _from_initial("make_timestamp((total + lead)::BIGINT)"))
def premium_ledger_from(spark, sf_dir):
    return ops.premium_ledger(ops.apply_once(payments(spark, sf_dir)), profiles(spark, sf_dir)).select("payment_id", "user_id", "premium_until")


@REGISTRY.add("premium_ledger_unlimited", _from_initial("CASE WHEN NOT unlimited THEN make_timestamp((total + lead)::BIGINT) END"))
def premium_ledger_unlimited(spark, sf_dir):
    """Premium without an end stays so."""
    return ops.premium_ledger(ops.apply_once(payments(spark, sf_dir)), profiles(spark, sf_dir), keep_unlimited=True).select("payment_id", "user_id", "premium_until")


def subscription_events(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").where("event_type = 'signup'").select(
        e, "user_id", "ts", F.when(e % 4 == 0, "paused").when(e % 4 == 1, "cancelled").otherwise("authorized").alias("status"), (e % 6 != 3).alias("price_ok"), F.when(e % 5 > 0, F.col("ts") + ops.days(e % 40 - 5)).alias("next_ts")
    )


@REGISTRY.add(
    "subscription_state",
    """WITH s_ AS (SELECT event_id, user_id, ts, CASE event_id % 4 WHEN 0 THEN 'paused' WHEN 1 THEN 'cancelled' ELSE 'authorized' END AS status, event_id % 6 <> 3 AS price_ok, CASE WHEN event_id % 5 > 0 THEN ts + to_days((event_id % 40)::INT - 5) END AS next_ts FROM events WHERE event_type = 'signup')
    SELECT user_id, arg_max(status, {'a': ts, 'b': event_id}) AS status,
      max(CASE WHEN next_ts IS NULL THEN ts + INTERVAL 31 DAY ELSE greatest(next_ts, ts) END + INTERVAL 3 DAY) FILTER (status = 'authorized' AND price_ok) AS premium_until FROM s_ GROUP BY 1""",
)
def subscription_state(spark, sf_dir):
    return ops.subscription_state(subscription_events(spark, sf_dir))


@REGISTRY.add(
    "expire_charges",
    """WITH c_ AS (SELECT event_id AS charge_id, user_id, ts FROM events WHERE event_type = 'signup'), a_ AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
    SELECT charge_id, c_.user_id, c_.ts, min(a_.ts) AS paid_ts, CASE WHEN min(a_.ts) IS NULL THEN 'expired' ELSE 'paid' END AS status
    FROM c_ LEFT JOIN a_ ON c_.user_id = a_.user_id AND a_.ts >= c_.ts AND a_.ts <= c_.ts + INTERVAL 60 MINUTE GROUP BY ALL""",
)
def expire_charges(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ops.expire_charges(e.where("event_type = 'signup'").select(F.col("event_id").alias("charge_id"), "user_id", "ts"), e.where("event_type = 'purchase'"))
