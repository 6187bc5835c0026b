"""The n-gram Jaccard join against a plain version."""

import random

import numpy as np
import pytest

from riskframe.llm import ngram_join
from tests.llm.brute import components, documents, shingles


def _corpus(seed, n=70, copies=7):
    """Groups of texts whose similarities lie on both sides of the bound, short ones, and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    passage = [word() for _ in range(40)]
    texts = ["", None, "  \n", "one", "one two", "ONE  two", "one two three", "one two", "one two three four", "w " * 30_000]
    for g in range(n):
        base = [word() for _ in range(rng.choice([3, 8, 11, 14, 30, 90, 400, 2000]))]
        if g % 3 == 0:
            base += passage
        texts.append(" ".join(base))
        for _ in range(copies):
            changed = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, len(base) // 80, len(base) // 50])):
                if rng.random() < 0.4:
                    changed.insert(rng.randrange(len(changed) + 1), word())
                elif rng.random() < 0.5 and len(changed) > 1:
                    changed.pop(rng.choice([0, len(changed) - 1]))
                else:
                    changed[rng.randrange(len(changed))] = word()
            texts.append(" ".join(changed).upper() if rng.random() < 0.1 else " ".join(changed))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("shingle", "percent", "block"), [(3, 90, 20_000), (5, 80, 5)])
def test_join(spark, shingle, percent, block):
    rows = _corpus(percent)
    sets = [shingles(text, shingle) for _, text in rows]
    want = components(sets, percent)
    got = ngram_join.jaccard_join(documents(spark, rows).repartition(5), shingle, percent, block).collect()
    assert sorted(tuple(r) for r in got) == [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, want, strict=True))]


def test_repeats_nulls_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(9, text), (9, text), (None, text.upper()), (4, text + " more"), (4, None), (None, None), (2, "lone words")]
    got = ngram_join.jaccard_join(documents(spark, rows), 3, 90).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(9, 198, 4), (9, 198, 4), (None, 198, 4), (4, 199, 4), (4, 0, 4), (None, 0, None), (2, 1, 2)], key=str)
    assert ngram_join.jaccard_join(documents(spark, []), 3, 90).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_split_and_pass_the_bitmap(percent):
    rng = np.random.default_rng(percent)
    for size in [*range(1, 60), 100, 333, 1500, 9000]:
        for _ in range(6):
            base = np.unique(rng.integers(0, 2**63, size + 200, dtype=np.uint64))
            n = min(size, len(base))
            a, grown = np.sort(rng.permutation(base)[:n]), int(rng.integers(0, max(1, n // 4) + 1))
            b = np.union1d(a[rng.random(n) > rng.choice([0, 0.03, 0.08])], rng.integers(0, 2**63, grown if rng.random() < 0.5 else 0, dtype=np.uint64))
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
                continue
            keys_a, keys_b = (ngram_join.split_keys(x, percent) for x in (a, b))
            shared = np.intersect1d(keys_a >> 1, keys_b >> 1)
            assert any((keys_a[keys_a >> 1 == k] | keys_b[keys_b >> 1 == k])[0] & 1 for k in shared)
            x, y = ngram_join.bitmap(a), ngram_join.bitmap(b)
            octets = min(len(x), len(y))
            assert np.bitwise_count(ngram_join.folded(x, octets) ^ ngram_join.folded(y, octets)).sum() <= ngram_join.most_apart(len(a), len(b), percent)


def test_tiles_cover_all_pairs_of_sizes():
    for percent in (70, 80, 90, 95):
        for n in range(1, 400):
            for other in range(n, 100 * n // percent + 1):
                small = {t for t, side in ngram_join.tiles_of(n, percent) if side}
                assert small & {t for t, _ in ngram_join.tiles_of(other, percent)}
                first, last, parts, spare, _ = ngram_join.tile(min(small), percent)
                assert first <= n <= last and ngram_join.most_apart(n, other, percent) + 1 + spare <= parts
