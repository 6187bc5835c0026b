"""Conversation repair against an exhaustive search, one edit at a time."""

import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from riskframe.llm import repair
from tests.llm.brute import sha

SCHEMA = "conv_id long, turn long, role string, text string, cost string, letter string"


def _search(rows):
    """Least ``(cost, audit, turns)`` of ``(role, text, fault)`` rows: a walk over (rows read, grammar state)."""
    heap, seen, done = [(0, "", 0, "", ())], set(), None
    while heap:
        cost, audit, i, state, turns = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(turns)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, turns))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for x in follows:
                    if role[:1] == x:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, x, (*turns, (role, text))))
                    if x in "ua":
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, x, (*turns, ({"u": "user", "a": "assistant"}[x], text))))
        for x in follows:
            if x in "ua":
                heapq.heappush(heap, (cost + 5, audit + "I", i, x, (*turns, ({"u": "user", "a": "assistant"}[x], ""))))
    return done


def _damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
        out += [(conv, turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def _expected(original, damaged):
    result = []
    for conv in {r[0] for r in original}:
        rows = sorted((r[1:] for r in damaged if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in rows if r[0] is not None]
        seen, faults = set(), []
        for _, role, text in rows:
            tail = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit, made = _search([(role, text, fault) for (_, role, text), fault in zip(rows, faults, strict=True)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        result.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in made))))
    return sorted(result, key=str)


def _conversations(seed, n=150):
    rng = random.Random(seed)
    texts = ["Hi.", "Hi.", "no stop", " ", "", None, "ends! \n", "?\r\n \t", "é!", "x" * 5_000 + "."]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.choice([1, 2, 4, 8, 8, 12])):
            role = rng.choice(["user", "assistant"] * 5 + ["system", "", None, "tool", "u", "sys"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None, -turn]), role, rng.choice(texts) if rng.random() < 0.6 else f"word {rng.random()}."))
    rows += rng.sample(rows, 30)
    return [(*r, "own", "own") for r in rows]


def test_query(spark, tmp_path):
    rows = _conversations(1) + [(900, t, "user", "same.", "", "") for t in range(150)] + [(901, 3, "user", "twice.", "", "")] * 200
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((tuple(r) for r in repair.op13_structure_repair(spark, str(tmp_path)).collect()), key=str)
    assert got == _expected(rows, _damaged(rows))


def test_undamaged_turns(spark):
    rows = _conversations(2, 40)
    audits, turns = repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(7))
    spaced = [(r[0], r[1], *(" " if x is None else x for x in r[2:4])) for r in rows]
    want = _expected(rows, spaced)
    digests = {r["conv_id"]: r["sha256"] for r in repair.hashed(turns).collect()}
    assert sorted(((*r, digests.get(r["conv_id"], sha(""))) for r in audits.collect()), key=str) == want
    grammar = re.compile("(s?(ua)+)?")
    for row in turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role"))).alias("t")).collect():
        assert [t["place"] for t in row["t"]] == list(range(1, len(row["t"]) + 1))
        assert grammar.fullmatch("".join(t["role"][0] for t in row["t"]))


def test_nothing_left(spark, tmp_path):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(dropped, 0, "user", "Hi.", "", "")], SCHEMA).write.parquet(path)
    assert [tuple(r) for r in repair.op13_structure_repair(spark, str(tmp_path)).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", sha(""))]
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)
    assert repair.op13_structure_repair(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("segment", [1, 2, 5, 64])
def test_align(segment):
    rng, names = random.Random(segment), {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for _ in range(400):
        letters = "".join(rng.choice("uauauasoUAwxyz") for _ in range(rng.choice([0, 1, 3, 6, 11])))
        rows = [(names["suao"[repair._LETTERS.index(x) % 4]], "t", [None, "truncated", "blank", "duplicate"][repair._LETTERS.index(x) // 4]) for x in letters]
        cost, audit, turns = repair.repaired(letters, segment)
        assert (cost, audit) == _search(rows)[:2]
        made = [(role or rows[at][0], "" if at is None else "t") for at, role in turns]
        assert made == _search(rows)[2]


def test_align_long():
    rng = random.Random(9)
    letters = "".join(rng.choice("uauaoUs") for _ in range(3000))
    assert repair.align(letters) == repair.align(letters, 17)
