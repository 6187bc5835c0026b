"""Exact and near copies against plain versions."""

import random

import pytest

from riskframe.llm import exact, neardup
from tests.llm.brute import LOWER, components, documents, sha, shingles

ROWS = [(1, "Same Text"), (5, "same text"), (3, "SAME TEXT"), (5, "same text"), (2, None), (7, ""), (None, "same text"), (8, "Ä"), (9, "ä"), (None, "alone"), (None, "alone"), (10, "x" * 100_000)]


def _expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(sha((text or "").translate(LOWER)), []).append(doc_id)
    out = []
    for digest, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        first = ids.index(keep)
        out += [(i, keep, len(ids), n == first, digest) for n, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize("counters", [1, 2, 1024])
def test_exact_duplicates(spark, counters):
    rows = ROWS + [(100 + i, "hot") for i in range(50)]
    got = exact.exact_duplicates(documents(spark, rows).repartition(5), counters).collect()
    assert sorted([tuple(r) for r in got], key=str) == _expected(rows)


def test_exact_deduplicate_keeps_rows_and_columns(spark):
    rows = ROWS + [(1, "same text")] * 5
    table = documents(spark, rows)
    got = exact.deduplicate(table)
    assert got.columns == table.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(5, "same text"), (7, ""), (8, "Ä"), (9, "ä"), (None, "alone"), (10, "x" * 100_000)], key=str)
    assert exact.deduplicate(documents(spark, [])).count() == 0


def test_misra_gries_finds_the_frequent():
    rng = random.Random(1)
    stream = ["hot"] * 400 + [str(i) for i in range(600)]
    rng.shuffle(stream)
    held = exact.misra_gries([stream[i : i + 50] for i in range(0, 1000, 50)], 4)
    assert "hot" in held and len(held) <= 4 and held["hot"] >= 400 - 1000 / 5


def _corpus(seed, n=60, copies=6):
    """Groups of texts with a growing number of changed words, so that similarities lie on both sides of the bound."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows, texts = [], ["", None, "  ", "one", "one two", "ONE  two", "one two three", "one two"]
    for _ in range(n):
        base = [word() for _ in range(rng.choice([5, 30, 200, 1500]))]
        texts.append(" ".join(base))
        for c in range(copies):
            changed = list(base)
            for _ in range(int(len(base) * rng.choice([0.005, 0.02, 0.04, 0.06]) * (c > 0)) + (c > 0)):
                changed[rng.randrange(len(changed))] = word()
            texts.append(" ".join(changed).title() if c == 0 else " ".join(changed))
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    return rows


@pytest.mark.parametrize(("shingle", "percent", "rows_in_band"), [(3, 85, 5), (5, 80, 4)])
def test_near_duplicates(spark, shingle, percent, rows_in_band):
    rows = _corpus(shingle)
    sets = [shingles(text, shingle) for _, text in rows]
    want = components(sets, percent)
    got = neardup.near_duplicates(documents(spark, rows), shingle, percent, rows_in_band, block=7).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [(i, len(s), c, i == c) for i, (s, c) in enumerate(zip(sets, want, strict=True))]


def test_near_deduplicate_keeps_one_of_each(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(4, long), (4, long), (9, long.replace("w50 ", "q ")), (2, "short one"), (2, "short one"), (6, None), (7, ""), (None, "lone words here"), (11, long + " " + long)]
    table = documents(spark, rows)
    got = neardup.deduplicate(table)
    assert got.columns == table.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:5]) for r in got.collect()) == sorted([("4", "w0 w1"), ("2", "short"), ("6", ""), ("7", ""), ("None", "lone "), ])
    assert neardup.deduplicate(documents(spark, [])).count() == 0


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 300), (300, 200), (500, 500)]
    got = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0
