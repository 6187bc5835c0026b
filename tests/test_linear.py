"""Operators whose time follows the text: taint in one pass, and the function around a line by binary search."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.operators import detect, taint
from riskframe.operators.python_facts import first_used, propagated

SOURCE = re.compile("|".join(rules.TAINT_SOURCES))


def _one_by_one(lines):
    """Every assignment against every name so far, as written in the survey."""
    names = []
    for line in lines:
        assigned = re.match(r"\s*([A-Za-z_][A-Za-z0-9_]*)\s*=", line)
        lower = line.lower()
        if assigned and (SOURCE.search(lower) or any(re.search(rf"\b{re.escape(n)}\b", lower) for n in names)) and assigned[1] not in names:
            names.append(assigned[1])
    return names


def _program(seed, n=60):
    rng = random.Random(seed)
    names = ["a", "b", "Big", "c1", "_d", "value", "aé", "ab"]
    right = lambda: rng.choice(["input()", "sys.argv[1]", "1", *names, f"f({rng.choice(names)})", f"x.{rng.choice(names)}", f"'{rng.choice(names)}'"])
    return [rng.choice(["  ", "", "\t"]) + rng.choice([f"{rng.choice(names)} = {right()}", f"{rng.choice(names)}={right()} + {right()}", "def f(x):", f"eval({rng.choice(names)})", ""]) for _ in range(n)]


def test_taint_equals_one_by_one(spark):
    texts = {i: _program(i) for i in range(60)}
    rows = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], "file_id int, content string")
    got = {}
    for r in taint.taint_map(rows).orderBy("file_id", "pos").collect():
        got.setdefault(r["file_id"], []).append(r["variable"])
    assert got == {i: names for i, t in texts.items() if (names := _one_by_one(t))}


def test_first_used_variable():
    names = propagated("b = input()\nA = 1\nc = b\nB = c", SOURCE)
    assert list(names) == ["b", "c", "B"]
    assert first_used(names, ["f(c, B)", "x", None, "C", "bc"]) == ["b", None, None, "c", None]


@pytest.mark.parametrize("n", [100_000])
def test_taint_is_linear(spark, n):
    """A chain of n names, each fed by the one before: five times the names take about five times as long."""
    def seconds(k):
        text = "\n".join(["v0 = input()"] + [f"v{i} = f(v{i - 1})" for i in range(1, k)])
        rows = spark.createDataFrame([(1, text)], "file_id int, content string")
        start = time.perf_counter()
        assert taint.taint_map(rows).agg(F.count("*"), F.max("pos")).first() == (k, k - 1)
        return time.perf_counter() - start

    seconds(1_000)
    small = seconds(n // 5)
    assert seconds(n) < 5 + 15 * small


def test_enclosing_function(spark):
    rng = random.Random(4)
    for n in (0, 1, 2, 7, 8, 9, 500):
        starts = sorted(rng.sample(range(1, 2_000), n))
        queries = [0, 1, 5_000, *starts, *[rng.randrange(2_000) for _ in range(50)]]
        rows = spark.createDataFrame([([(line, f"f{line}") for line in starts], queries)], "starts array<struct<line:int,name:string>>, q array<int>")
        got = rows.select(F.transform("q", lambda line: detect.enclosing_function(F.col("starts"), line)).alias("x")).first()["x"]
        assert got == [max((f"f{s}" for s in starts if s <= q), key=lambda x: int(x[1:]), default="") for q in queries]


def test_enclosing_function_of_many_hits(spark):
    """50,000 hits among 50,000 functions."""
    n = 50_000
    rows = spark.range(1).select(
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct((2 * i).cast("int").alias("line"), i.cast("string").alias("name"))).alias("starts"),
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (2 * i + 1).cast("int")).alias("hits"),
    ).cache()
    rows.count()
    start = time.perf_counter()
    found = F.transform("hits", lambda line: detect.enclosing_function(F.col("starts"), line))
    got = rows.select(F.explode(found).alias("name")).agg(F.count("*"), F.max(F.col("name").cast("int"))).first()
    assert got == (n, n) and time.perf_counter() - start < 60
    rows.unpersist()
