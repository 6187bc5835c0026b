"""Packing: tokens as the tokenizer gives them, and packings that hold every piece once."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskframe.llm import packing
from tests.llm.brute import documents

TEXTS = ["", None, "a", "Hello world's end, they'll see.  12 345\n\n x", "<|endoftext|> it", "日本語 text", "é" * 50, " " * 3000, "ab" * 1500, "word " * 3000, "\u0250\u2028\x85\xa0 z", "tail "] + [
    "".join(random.Random(i).choice("ab c'stdéü 1\n\t,.€—„“😀") for _ in range(400)) for i in range(40)
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def _ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_pieces(spark, tokenizer):
    for capacity in (2048, 100):
        got = {}
        for r in packing.pieces(documents(spark, list(enumerate(TEXTS))), capacity).collect():
            got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        for i, text in enumerate(TEXTS):
            ids = _ids(tokenizer, text)
            parts = sorted(got[i])
            assert [p[0] for p in parts] == list(range(-(-len(ids) // capacity)))
            assert [p[2] for p in parts[1:]] == [capacity] * (len(parts) - 1) and sum(p[2] for p in parts) == len(ids)
            assert all(zlib.crc32(ids[s : s + n].tobytes()) == crc for _, s, n, crc in parts)


def _used(rows):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
    return {k: sum(n for _, n in v) for k, v in sequences.items()}


def test_documents_are_packed_whole_and_tight(spark):
    rng = random.Random(3)
    rows = [(i % 90 if i > 5 else None, " ".join(rng.choice(["cat", "running", "tree"]) for _ in range(rng.randrange(0, 900)))) for i in range(300)]
    got = packing.pack_documents(documents(spark, rows), capacity=512, shard_items=60).collect()
    used = _used(got)
    assert max(used.values()) <= 512
    total = sum(used.values())
    assert sum(r["piece"] == 0 for r in got) == len(rows)
    assert len(used) <= -(-total // 512) + 6
    assert packing.pack_documents(documents(spark, [])).count() == 0
    one = packing.pack_documents(documents(spark, [(1, None)])).collect()
    assert [(r["doc_id"], r["piece"], r["length"], r["offset"]) for r in one] == [(1, 0, 1, 0)]


def test_evolution_improves_on_best_fit():
    rng = np.random.default_rng(1)
    better = 0
    for seed in range(8):
        lengths = [int(x) for x in rng.integers(200, 900, 120)]
        first = packing.best_fit(lengths, list(range(120)), [], 2048)
        best = packing.evolve(lengths, [], seed, 2048, population=8, generations=40)
        assert sorted(i for b in best for i in b) == list(range(120))
        assert all(sum(lengths[i] for i in b) <= 2048 for b in best)
        assert packing.fitness(lengths, best, 2048) <= packing.fitness(lengths, first, 2048)
        better += len(best) < len(first)
    assert better >= 1


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(2)
    lengths = [int(x) for x in rng.integers(1, 1500, 200)]
    a = packing.best_fit(lengths, list(range(200)), [], 2048)
    b = packing.evolve(lengths, [], 5)
    child = packing._injected(lengths, a, b, 2048, rng)
    assert sorted(i for x in child for i in x) == list(range(200))
    assert all(sum(lengths[i] for i in x) <= 2048 for x in child)
