"""The payment feed as streams: at-least-once delivery in, each payment credited once.

``credits`` keeps a mark for each payment for good (no time-out: a late repeat must still not credit);
``premium`` keeps each user's end of premium. Both use ``transformWithStateInPandas``, whose state is
in the RocksDB store and is written with the checkpoint, so a restart goes on where it was. Notices
may come in any order across payments; a payment's first approved notice credits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampNTZType

from leafloom.operators.ledger import CHARGE_MINUTES, GRACE_DAYS, OPEN_DAYS, PERIODS, route_events, verify_signatures
from leafloom.operators.keyed import KeyedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CREDIT = "payment_id string, user_id bigint, period string, ts timestamp_ntz"
LEDGER = "user_id bigint, payment_id string, premium_until timestamp_ntz"


class ApplyOnce(StatefulProcessor):
    """A payment's first approved notice becomes a credit; all later notices of it give nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", StructType([StructField("done", BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            return
        best = None
        for part in rows:
            good = part[part["status"] == "approved"].sort_values(["ts", "user_id", "period"])
            if len(good) and (best is None or (good.iloc[0]["ts"], good.iloc[0]["user_id"], good.iloc[0]["period"]) < (best["ts"], best["user_id"], best["period"])):
                best = good.iloc[0]
        if best is not None:
            self.done.update((True,))
            yield pd.DataFrame({"payment_id": [key[0]], "user_id": [int(best["user_id"])], "period": [best["period"]], "ts": [best["ts"]]})

    def close(self) -> None:
        pass


class Premium(StatefulProcessor):
    """Each credit adds its days to the later of its own time and the end so far; credits of one batch
    are taken in order of time. The contract is that of a feed: a credit of a later batch counts after
    those of earlier ones, whatever its time; fed in order of time, ends are those of the batch form."""

    def __init__(self, keep_unlimited: bool = False):
        self.keep_unlimited = keep_unlimited

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", StructType([StructField("until", TimestampNTZType()), StructField("unlimited", BooleanType())]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        held = initialState[initialState["plan"] == "premium"]
        if not len(held):
            return
        end = held["premium_until"].iloc[0]
        if not pd.isna(end):
            self.until.update((pd.Timestamp(end).to_pydatetime(), False))
        elif self.keep_unlimited:
            self.until.update((None, True))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        credits = pd.concat(list(rows)).sort_values(["ts", "payment_id"])  # the credits of one user in one batch
        end, unlimited = self.until.get() if self.until.exists() else (None, False)
        end = None if end is None else pd.Timestamp(end)
        out = []
        for c in credits.itertuples():
            if not unlimited:
                start = c.ts if end is None else max(end, c.ts)
                end = start + pd.Timedelta(days=PERIODS[c.period][1])
            out.append((int(key[0]), c.payment_id, end))
        self.until.update((None if end is None else end.to_pydatetime(), unlimited))
        yield pd.DataFrame(out, columns=["user_id", "payment_id", "premium_until"]).astype({"premium_until": "datetime64[us]"})

    def close(self) -> None:
        pass


class Subscription(StatefulProcessor):
    """Of each user the latest status by (ts, event_id), and the latest end of premium that an authorized
    event gave: events may come in any order and more than once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [StructField("status", StringType()), StructField("ts", TimestampNTZType()), StructField("event_id", LongType()), StructField("until", TimestampNTZType())]
        self.held = handle.getValueState("held", StructType(fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, ts, event_id, until = self.held.get() if self.held.exists() else (None, None, None, None)
        for part in rows:
            for e in part.itertuples():
                if ts is None or (e.ts, e.event_id) > (pd.Timestamp(ts), event_id):
                    status, ts, event_id = e.status, e.ts.to_pydatetime(), int(e.event_id)
                if e.status == "authorized" and e.price_ok:
                    base = e.ts + pd.Timedelta(days=OPEN_DAYS) if pd.isna(e.next_ts) else max(e.next_ts, e.ts)
                    end = (base + pd.Timedelta(days=GRACE_DAYS)).to_pydatetime()
                    until = end if until is None else max(until, end)
        self.held.update((status, ts, event_id, until))
        yield pd.DataFrame({"user_id": [int(key[0])], "status": [status], "premium_until": pd.Series([until], dtype="datetime64[us]")})

    def close(self) -> None:
        pass


def credits(notices: DataFrame) -> DataFrame:
    """Stream of notices (payment_id, user_id, period, status, ts) to a stream of credits, one a payment."""
    return notices.groupBy("payment_id").transformWithStateInPandas(ApplyOnce(), outputStructType=CREDIT, outputMode="append", timeMode="none")


def premium(credited: DataFrame, initial: DataFrame | None = None, *, keep_unlimited: bool = False) -> DataFrame:
    """Stream of credits to a stream of each user's end of premium after each of them. ``initial``
    (user_id, plan, premium_until: a table) has what users start with, as in the batch form."""
    held = None if initial is None else initial.groupBy("user_id")
    return credited.groupBy("user_id").transformWithStateInPandas(Premium(keep_unlimited), outputStructType=LEDGER, outputMode="append", timeMode="none", initialState=held)


def subscriptions(events: DataFrame) -> DataFrame:
    """Stream of subscription events (event_id, user_id, ts, status, price_ok, next_ts) to a stream of each
    user's state, a row for each batch that has events of the user; the last one holds."""
    return events.groupBy("user_id").transformWithStateInPandas(Subscription(), outputStructType="user_id bigint, status string, premium_until timestamp_ntz", outputMode="append", timeMode="none")


def expire_charges(charges: DataFrame, approvals: DataFrame, late: str = "10 minutes", minutes: int = CHARGE_MINUTES) -> DataFrame:
    """Interval join of two streams: each charge with the approvals of its user within the minutes after
    it; a charge without one comes out, as expired, once the watermark has passed its last minute. Charges and
    approvals behind the watermark are dropped; ``LateRows`` counts them."""
    a = charges.withWatermark("ts", late)
    b = approvals.select(F.col("user_id").alias("u"), F.col("ts").alias("paid_ts")).withWatermark("paid_ts", late)
    within = F.expr(f"user_id = u AND paid_ts >= ts AND paid_ts <= ts + INTERVAL {minutes} MINUTES")
    rows = a.join(b, within, "left_outer")
    return rows.select("charge_id", "user_id", "ts", "paid_ts", F.when(F.col("paid_ts").isNotNull(), "paid").otherwise("expired").alias("status"))


def routed(notices: DataFrame, secret: str) -> DataFrame:
    """Stream of signed notices with ``valid`` and ``route``, for the sinks of ``by_route``."""
    return route_events(verify_signatures(notices, secret))


def by_route(sinks: dict[str, Callable[[DataFrame, int], None]], rejected: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands each route's valid rows to its sink, and the others to
    ``rejected``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            rejected(batch.where("NOT valid"), batch_id)
            for route, sink in sinks.items():
                sink(batch.where(F.col("valid") & (F.col("route") == route)), batch_id)
        finally:
            batch.unpersist()

    return run


def create_profiles(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds a profile (user_id, created) for each new user; users that the table
    holds are left as they are. Only the buckets of a batch's users are read, and only those with a new one get
    a file, so a batch that is fed again changes nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        table.insert_ignore(batch.groupBy("user_id").agg(F.min("ts").alias("created")))

    return run


class LateRows(StreamingQueryListener):
    """Counts, by query name, the rows that came after their watermark and were dropped. Add it to
    ``spark.streams`` before the queries start; progress arrives a moment after each batch."""

    def __init__(self) -> None:
        self.dropped: dict[str | None, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(event.name, 0)

    def onQueryProgress(self, event) -> None:
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.dropped[event.progress.name] = self.dropped.get(event.progress.name, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
