"""Streams give what the batch forms give, over several batches, with repeats and restarts."""

from pyspark.sql import functions as F

from leafloom.operators import ledger
from leafloom.operators.keyed import KeyedTable
from leafloom.sources.derived import payments
from leafloom.streaming import ledger as live


def in_batches(spark, df, path, n=3):
    """Files of which a stream takes one a batch."""
    for k in range(n):
        df.where(F.pmod(F.xxhash64(*df.columns), F.lit(n)) == k).coalesce(1).write.parquet(str(path / f"part{k}"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part*")


def drain(df, out, checkpoint):
    q = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_each_payment_is_credited_once(spark, sf, tmp_path):
    notices = payments(spark, sf)
    drain(live.credits(in_batches(spark, notices, tmp_path / "in")), tmp_path / "out", tmp_path / "cp")
    got = {r.payment_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    rows = spark.read.parquet(str(tmp_path / "out")).count()
    want = {r.payment_id for r in ledger.apply_once(notices).collect()}
    assert got == want and rows == len(want)
    # Started again over the same folder with repeats added, it credits nothing twice.
    notices.where("status = 'approved'").coalesce(1).write.parquet(str(tmp_path / "in" / "part9"))
    again = spark.readStream.schema(notices.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part*")
    drain(live.credits(again), tmp_path / "out", tmp_path / "cp")
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(want)


def test_premium_stream_ends_where_the_batch_does(spark, sf, tmp_path):
    once = ledger.apply_once(payments(spark, sf)).select("payment_id", "user_id", "period", "ts")
    for k, (low, high) in enumerate([("2024-01-01", "2024-01-12"), ("2024-01-12", "2024-02-28")]):  # in order of time across batches
        once.where((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    stream = spark.readStream.schema(once.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part*")
    drain(live.premium(stream), tmp_path / "out", tmp_path / "cp")
    got = {r.payment_id: r.premium_until for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.payment_id: r.premium_until for r in ledger.premium_ledger(once).collect()}


def test_premium_stream_goes_on_from_what_users_have(spark, sf, tmp_path):
    from leafloom.plans.entitlements import profiles

    once = ledger.apply_once(payments(spark, sf)).select("payment_id", "user_id", "period", "ts")
    held = profiles(spark, sf)
    for keep in (False, True):
        base = tmp_path / str(keep)
        for k, (low, high) in enumerate([("2024-01-01", "2024-01-12"), ("2024-01-12", "2024-02-28")]):
            once.where((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.parquet(f"{base}/in/part{k}")
        stream = spark.readStream.schema(once.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/part*")
        drain(live.premium(stream, held, keep_unlimited=keep), base / "out", base / "cp")
        got = {r.payment_id: r.premium_until for r in spark.read.parquet(str(base / "out")).collect()}
        assert got == {r.payment_id: r.premium_until for r in ledger.premium_ledger(once, held, keep_unlimited=keep).collect()}
        assert keep == (None in got.values())


def test_subscriptions_as_a_stream(spark, sf, tmp_path):
    """Batches in any order of time, with repeats and a restart: the last row of a user is the batch form's."""
    from leafloom.plans.payments import subscription_events

    events = subscription_events(spark, sf)
    out, cp = tmp_path / "out", tmp_path / "cp"
    drain(live.subscriptions(in_batches(spark, events, tmp_path / "in")).withColumn("seen", F.current_timestamp()), out, cp)
    events.where("event_id % 3 = 0").coalesce(1).write.parquet(str(tmp_path / "in" / "part9"))
    again = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part*")
    drain(live.subscriptions(again).withColumn("seen", F.current_timestamp()), out, cp)
    rows = spark.read.parquet(str(out)).groupBy("user_id").agg(F.max_by(F.struct("status", "premium_until"), "seen").alias("r")).select("user_id", "r.*")
    want = ledger.subscription_state(events).select("user_id", "status", "premium_until")
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_charges_expire_by_watermark(spark, tmp_path):
    charges = spark.createDataFrame([(1, 7, "2024-01-01 00:00:00"), (2, 8, "2024-01-01 00:00:00"), (3, 9, "2024-01-03 00:00:00")], "charge_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    paid = spark.createDataFrame([(7, "2024-01-01 00:59:00"), (8, "2024-01-01 01:01:00"), (9, "2024-01-04 00:00:00")], "user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    a, b = in_batches(spark, charges, tmp_path / "a", 1), in_batches(spark, paid, tmp_path / "b", 1)
    drain(live.expire_charges(a, b), tmp_path / "out", tmp_path / "cp")
    got = {(r.charge_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {(1, "paid"), (2, "expired")} <= got


def test_notices_are_checked_and_routed(spark, tmp_path):
    from leafloom.functions.text import hmac_sha256

    rows = spark.createDataFrame([("payment", "a1"), ("preapproval", "b2"), ("payment", "bad"), ("other", "c3")], "type string, data_id string")
    v1 = F.when(F.col("data_id") == "bad", "00").otherwise(hmac_sha256("k", F.concat(F.lit("id:"), "data_id", F.lit(";ts:5;"))))
    rows = rows.withColumns({"topic": F.lit(None).cast("string"), "id": F.lit(None).cast("string"), "request_id": F.lit(None).cast("string"), "header": F.concat(F.lit("ts=5,v1="), v1)})
    seen = {}
    keep = lambda name: lambda df, _: seen.setdefault(name, []).extend(r.data_id for r in df.collect())
    stream = live.routed(in_batches(spark, rows, tmp_path / "in", 1), "k")
    q = stream.writeStream.foreachBatch(live.by_route({r: keep(r) for r in ("payment", "preapproval", "ignored")}, keep("rejected"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {k: sorted(v) for k, v in seen.items()} == {"payment": ["a1"], "preapproval": ["b2"], "ignored": ["c3"], "rejected": ["bad"]}


def test_profiles_are_created_once(spark, sf, tmp_path):
    signups = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'signup'").select("user_id", "ts")
    q = in_batches(spark, signups, tmp_path / "in").writeStream.foreachBatch(live.create_profiles(KeyedTable(spark, str(tmp_path / "profiles"), "user_id bigint, created timestamp_ntz", "user_id", buckets=4))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [r.user_id for r in spark.read.parquet(str(tmp_path / "profiles")).collect()]
    assert sorted(rows) == sorted(r.user_id for r in signups.select("user_id").distinct().collect())
