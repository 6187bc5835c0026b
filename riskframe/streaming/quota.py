"""Daily quotas over a stream of requests (operator W5), with keyed state and event-time timers.

A request may arrive after later ones. Each is answered when it arrives, from the requests that are known by then; a request that
comes late can take the place of a later one, which is then answered again. The answer of the last batch counts, and it is the one
that the batch operator gives on the same requests.

State of an actor and day: the admitted requests, in order. The actors of a bucket share a key of the state, as a key costs about a
millisecond of calls to the store, whatever it holds. The admitted requests are enough, as requests only ever lose their place: one more
earlier request never lowers the count that a later one meets, so whoever is refused stays refused. It also bounds the state by
the largest limit, however many requests an actor sends. A timer drops the state once the day is late; requests that come later than
the watermark allows are dropped by Spark and get no answer.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from riskframe import rules
from riskframe.operators.limits import Limits, with_plan_limits
from riskframe.sources.log_table import LogTable
from riskframe.streaming.jobs import checkpoint_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DECISION_SCHEMA = "scan_id long, actor_key string, usage_date date, plan string, admitted boolean"
#: Keys of the state for each day.
BUCKETS = 256
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(held: list[tuple], arriving: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Admitted and refused of ``(time, scan_id, plan, limit)`` rows, walked in the order of time."""
    admitted, refused = [], []
    for request in sorted(held + arriving):
        (admitted if len(admitted) < request[3] else refused).append(request)
    return admitted, refused


class DailyQuota(StatefulProcessor):
    """Decisions of one day for the actors of a bucket."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "actor_key string, micros long, scan_id long, plan string, daily int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, day = key
        held, arriving, answers = defaultdict(list), defaultdict(list), []
        for actor, *request in self.held.get():
            held[actor].append(tuple(request))
        for batch in rows:
            for actor, *request in batch[["actor_key", "micros", "scan_id", "plan", "daily"]].itertuples(index=False, name=None):
                arriving[actor].append(tuple(request))
        if not held:
            # No request of the day can come once the watermark is past its end in every time zone.
            self.handle.registerTimer(int(dt.datetime.combine(day + dt.timedelta(days=2), dt.time(), dt.timezone.utc).timestamp() * 1000))
        for actor, requests in arriving.items():
            known = {request[1] for request in held[actor]}
            held[actor], refused = replay(held[actor], requests)
            answers += [(actor, r, True) for r in held[actor] if r[1] not in known] + [(actor, r, False) for r in refused]
        if admitted := [(actor, *request) for actor, requests in held.items() for request in requests]:
            self.held.put(admitted)
        yield pd.DataFrame({
            "scan_id": pd.Series([r[1] for _, r, _ in answers], dtype="int64"), "actor_key": [actor for actor, _, _ in answers],
            "usage_date": day, "plan": [r[2] for _, r, _ in answers], "admitted": pd.Series([a for _, _, a in answers], dtype="bool"),
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def decisions(requests: DataFrame, limits: Limits = rules.PLAN_LIMITS, delay: str = "1 day") -> DataFrame:
    """Answers to a stream of ``scan_id, actor_key, ts, plan``; the last one per ``scan_id`` counts."""
    timed = requests.select("scan_id", "actor_key", F.col("ts").cast("timestamp").alias("ts"), "plan").withWatermark("ts", delay)
    rows = with_plan_limits(timed, "plan", limits).select(
        F.col("scan_id").cast("long").alias("scan_id"), "actor_key", F.to_date("ts").alias("usage_date"), "ts",
        F.unix_micros("ts").alias("micros"), "plan", F.col("daily_scan_limit").cast("int").alias("daily"),
    )
    bucket = F.pmod(F.xxhash64("actor_key"), F.lit(BUCKETS)).cast("int")
    counted = rows.where(F.col("daily").isNotNull()).withColumn("bucket", bucket).groupBy("bucket", "usage_date").transformWithStateInPandas(
        DailyQuota(), DECISION_SCHEMA, "Update", "EventTime"
    )
    # Requests without a limit are admitted as they come.
    free = rows.where(F.col("daily").isNull()).select("scan_id", "actor_key", "usage_date", "plan", F.lit(True).alias("admitted"))
    return counted.unionByName(free)


def decision_table(spark: SparkSession, path: str) -> LogTable:
    return LogTable(spark, path, ["scan_id"], DECISION_SCHEMA)


def start_quota(
    requests: DataFrame, out: str, checkpoint: str | None = None, limits: Limits = rules.PLAN_LIMITS, delay: str = "1 day"
) -> StreamingQuery:
    """Keep the answers to a stream of requests in a table (:func:`decision_table`)."""
    spark = requests.sparkSession
    folder = checkpoint_folder(spark, "quota", checkpoint)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # keyed state of this kind has no other store; a query keeps the setting it starts with
    try:
        return (
            decisions(requests, limits, delay).writeStream.outputMode("update").option("checkpointLocation", folder)
            .foreachBatch(lambda batch, batch_id: decision_table(batch.sparkSession, out).write(batch, batch_id))
            .trigger(availableNow=True).start()
        )
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
