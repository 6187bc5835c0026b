"""Mixing against a one-block-at-a-time version."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from riskframe.llm import mixing
from tests.llm.brute import documents, words


def _targets(sizes):
    """Targets by capping the highest source again and again, in exact numbers."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: Fraction((5, 2, 1)[i % 3]) for i, s in enumerate(names)}
    left, free, target = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: Fraction(2 * sizes[s]) for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    return {s: (target[s], i) for i, s in enumerate(names)}


def _seats(votes, n):
    """Seats one by one to the highest quotient; ``votes`` in the order that breaks ties."""
    seats = [0] * len(votes)
    for _ in range(n):
        seats[max(range(len(votes)), key=lambda i: (Fraction(votes[i]) / (2 * seats[i] + 1), -i))] += 1
    return seats


def _corpus():
    rows, n = [], 0
    for source, docs, length in (("b", 400, 30), ("a", 40, 25), ("é", 30, 40), ("c", 3, 7), (None, 20, 11), ("Z", 1, 500), ("none", 4, 0)):
        for i in range(docs):
            rows.append((n, " ".join(["w"] * (length + i % 3 if length else 0)) or (None if i % 2 else " "), source))
            n += 1
    return rows


def test_targets_and_taken(spark):
    rows = _corpus()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    want = _targets(sizes)
    table = documents(spark, rows).select("doc_id", "source", mixing.n_words(F.coalesce("text", F.lit(""))).alias("size"))
    got = mixing.mix(table, shard_docs=50).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["size"] == len(words(rows[r["doc_id"]][1])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(want[r["source"]][0]))
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for source, (target, _) in want.items():
        assert abs(taken[source] - target) <= mixing.BLOCK * (2 + sizes[source] // 1000), source
    again = mixing.mix(table.repartition(7), shard_docs=50).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_quotas_are_those_of_one_seat_at_a_time(spark):
    votes = [1000.0, 1000.0, 1000.0, 333.0, 17.0, 16.0, 0.0, 52_000.0, 8.0, 8.0, 24.0] + [40.0] * 30
    goals = spark.createDataFrame([(str(i), v, i) for i, v in enumerate(votes)], "source string, target double, rank long")
    got = {r["rank"]: r["quota"] for r in mixing.source_quotas(goals, 16).collect()}
    assert [got[i] for i in range(len(votes))] == _seats(votes, round(sum(votes) / 16))
    shards = [(0, i, s, 77) for i, s in enumerate([100, 100, 3, 0, 560, 90])] + [(1, 0, 0, 0), (1, 1, 0, 0)]
    got = {(r["nth_source"], r["shard"]): r["shard_quota"] for r in mixing.shard_quotas(spark.createDataFrame(shards, "nth_source long, shard long, shard_size long, quota long")).collect()}
    assert [got[0, i] for i in range(6)] == _seats([100, 100, 3, 0, 560, 90], 77) and got[1, 0] == got[1, 1] == 0


def test_mixed_documents_hold_what_is_taken(spark):
    rows = [(i, " ".join(f"{i}w{k}" for k in range(23 + i % 5)), "ab"[i % 7 == 0]) for i in range(300)] + [(300, None, "a"), (301, " \t", None), (301, " \t", None)]
    table = documents(spark, rows)
    size = table.select("doc_id", "source", mixing.n_words(F.coalesce("text", F.lit(""))).alias("size"))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(size, shard_docs=40).collect()}
    got = mixing.mixed_documents(table, shard_docs=40)
    assert got.columns == table.columns
    held = {}
    for r in got.collect():
        mine = words(r["text"])
        if not mine:  # copies of documents without words
            assert r["doc_id"] >= 300
            continue
        original = words(rows[r["doc_id"]][1])
        at = original.index(mine[0])
        assert original[at : at + len(mine)] == mine and r["n_chars"] == len(r["text"])
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + len(mine)
    assert held == {k: v for k, v in taken.items() if v}
    assert mixing.mixed_documents(documents(spark, [])).count() == 0


def test_words_between_keeps_spacing(spark):
    df = spark.createDataFrame([("  a\tb  c\nd é ", 1, 3), ("a b", 0, 2), ("x", 0, 0)], "t string, a long, b long")
    assert [r[0] for r in df.select(mixing.words_between(F.col("t"), F.col("a"), F.col("b"))).collect()] == ["b  c", "a b", ""]
