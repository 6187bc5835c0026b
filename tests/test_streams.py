"""Tables that batches change, and quotas over streams, against one pass over everything."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from riskframe.operators import quota
from riskframe.rules import PlanLimits
from riskframe.sources import sinks
from riskframe.sources.log_table import LogTable
from riskframe.streaming import quota as stream_quotas

SCHEMA = "k string, v long"


class Lost(Exception):
    pass


def _rows(table):
    return {r["k"]: r["v"] for r in table.read().collect()}


def test_log_table_merges_and_stays_small(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "t"), ["k"], SCHEMA, most_deltas=2)
    assert _rows(table) == {}
    rng, want = random.Random(1), {}
    for batch in range(12):
        changed = {rng.choice("abcdef"): rng.randrange(100) for _ in range(3)}
        want |= changed
        for _ in range(rng.choice([1, 2])):  # batches may run again
            table.write(spark.createDataFrame(list(changed.items()), SCHEMA), batch)
        assert _rows(table) == want and len(table.deltas()) <= 2
    # An old batch that runs again does not come back.
    table.write(spark.createDataFrame([("a", -1)], SCHEMA), 0)
    assert _rows(table) == want
    assert len(os.listdir(tmp_path / "t" / "base")) <= 4 and len(os.listdir(tmp_path / "t" / "delta")) <= 16


@pytest.mark.parametrize("lost_at", ["delta", "base", "pointer", "removal"])
def test_log_table_survives_a_crash(spark, tmp_path, monkeypatch, lost_at):
    table = LogTable(spark, str(tmp_path / "t"), ["k"], SCHEMA, most_deltas=1)
    make = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    for batch in range(4):
        table.write(make(("a", batch), (f"x{batch}", 1)), batch)
    before = _rows(table)

    def fail(*_):
        raise Lost

    if lost_at == "delta":  # part files without the mark of a committed job
        make(("a", 99)).write.parquet(str(tmp_path / "t" / "delta" / "4"))
        os.remove(tmp_path / "t" / "delta" / "4" / "_SUCCESS")
    else:
        target, name = {"base": (table, "_merged"), "pointer": (table.files, "replace"), "removal": (table.files, "remove")}[lost_at]
        with monkeypatch.context() as m:
            m.setattr(target, name, fail)
            with pytest.raises(Lost):
                table.write(make(("a", 4)), 4)
                table.write(make(("a", 4)), 5)
                table.compact()
    after = _rows(LogTable(spark, str(tmp_path / "t"), ["k"], SCHEMA, most_deltas=1))
    assert after in (before, before | {"a": 4})
    for batch in (4, 5):
        table.write(make(("a", 4)), batch)
    assert _rows(table) == before | {"a": 4}


@pytest.mark.parametrize("lost_at", ["findings", "commit", None])
def test_report_sink_gives_the_same_tables_when_it_runs_again(spark, tmp_path, monkeypatch, lost_at):
    path = str(tmp_path)
    finding = "line int, pattern string, severity double, src_rank int, seq int, type string, message string, note string"
    reports = lambda *ids: spark.createDataFrame([(i, [(1, "eval(", 1.0, 0, 0, "t", "m", "")] * i) for i in ids], f"file_id int, findings array<struct<{finding.replace(' ', ':').replace(',:', ',')}>>")
    sinks.write_reports(reports(1), path, ["file_id"], batch=0)

    def fail(*_, **__):
        raise Lost

    if lost_at:
        with monkeypatch.context() as m:
            m.setattr(sinks, "finding_rows", fail) if lost_at == "findings" else m.setattr(sinks._Files, "replace", fail)
            with pytest.raises(Lost):
                sinks.write_reports(reports(2, 3), path, ["file_id"], batch=1)
        assert sinks.read_reports(spark, path).count() == 1 and sinks.read_findings(spark, path).count() == 1
    for _ in range(2):
        sinks.write_reports(reports(2, 3), path, ["file_id"], batch=1)
    assert sorted(r["file_id"] for r in sinks.read_reports(spark, path).collect()) == [1, 2, 3]
    assert sorted(r["file_id"] for r in sinks.read_findings(spark, path).collect()) == [1, 2, 2, 3, 3, 3]


PLANS = {"free": PlanLimits(None, None, None, 3), "pro": PlanLimits(None, None, None, 7), "admin": PlanLimits(None, None, None, None)}


@pytest.mark.parametrize("order", ["time", "shuffled", "backwards"])
def test_stream_quota_equals_batch(spark, tmp_path, order):
    """The same requests in several arrival orders, one file a batch, with plans that change during a day and one hot actor."""
    rng, day = random.Random(3), dt.datetime(2024, 1, 1)
    actors = ["hot"] * 4 + [f"u{i}" for i in range(5)]
    rows = [(i, rng.choice(actors), day + dt.timedelta(days=rng.randrange(3), seconds=rng.randrange(86_400)), rng.choice(["free", "free", "pro", "admin"])) for i in range(300)]
    schema = "scan_id long, actor_key string, ts timestamp, plan string"
    whole = spark.createDataFrame(rows, schema)
    arriving = sorted(rows, key=lambda r: r[2], reverse=order == "backwards")
    if order == "shuffled":
        rng.shuffle(arriving)
    for n in range(5):
        part = spark.createDataFrame(arriving[n * 60 : (n + 1) * 60], schema).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_quotas.start_quota(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), PLANS, delay="10 days")
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 5
    got = {r["scan_id"]: r["admitted"] for r in stream_quotas.decision_table(spark, str(tmp_path / "out")).read().collect()}
    admitted = quota.admit(whole.withColumn("usage_date", F.to_date("ts")), None, PLANS)
    assert got == {r["scan_id"]: r["admitted"] for r in admitted.collect()}


def test_quota_state_holds_no_more_than_the_limit():
    held, refused = [], 0
    rng = random.Random(5)
    for _ in range(50):
        held, out = stream_quotas.replay(held, [(rng.random(), rng.randrange(10**9), "free", 5) for _ in range(20)])
        refused += len(out)
    assert len(held) == 5 and refused == 995


def test_actors_of_a_bucket_are_answered_each_for_themselves():
    import pandas as pd

    class Store(list):
        get, put = list.copy, lambda self, rows: self.__setitem__(slice(None), rows)
        getListState = lambda self, name, schema: self
        registerTimer = lambda self, at: None

    task, store = stream_quotas.DailyQuota(), Store()
    task.init(store)
    got = {}
    for batch in (range(6), range(6, 12)):
        rows = pd.DataFrame([("ab"[i % 2], 100 - i, i, "free", 2) for i in batch], columns=["actor_key", "micros", "scan_id", "plan", "daily"])
        for out in task.handleInputRows((7, dt.date(2024, 1, 1)), iter([rows]), None):
            got |= {r.scan_id: (r.actor_key, r.admitted) for r in out.itertuples()}
    assert got == {i: ("ab"[i % 2], i >= 8) for i in range(12)} and len(store) == 4
