"""Mined url rules against counting all combinations of the tokens of each url."""

import random
from collections import Counter
from itertools import combinations

from riskframe.llm import url_rules


def _counted(rows, min_support, min_confidence):
    """Rules by definition, from ``tokens, verdict`` of every url."""
    n, by_set = len(rows), {v: Counter() for v in url_rules.VERDICTS}
    for tokens, verdict in rows:
        for size in range(1, len(tokens) + 1):
            by_set[verdict].update(combinations(tokens, size))
    both = by_set["allow"] + by_set["block"]
    found = {(t, v): (k / both[t], k / n) for v in url_rules.VERDICTS for t, k in by_set[v].items() if k >= min_support * n and k >= min_confidence * both[t]}
    return {(t, v): c for (t, v), c in found.items() if not any(found.get((t[:i] + t[i + 1 :], v), (-1,))[0] >= c[0] for i in range(len(t)))}


def _mined(spark, rows, *limits):
    got = url_rules.mine(spark.createDataFrame([(list(t), v) for t, v in rows], "tokens array<string>, verdict string"), *limits).collect()
    assert len({(tuple(r["tokens"]), r["verdict"]) for r in got}) == len(got)
    return {(tuple(r["tokens"]), r["verdict"]): (r["confidence"], r["support"]) for r in got}


def test_every_frequent_token_is_mined(spark):
    """39 frequent tokens, some of one verdict, some in the same urls (a and b), one in all."""
    rng = random.Random(6)
    rows = []
    for i in range(900):
        site, part, kind, half = rng.randrange(20), rng.randrange(6), rng.randrange(4), rng.randrange(2)
        bad = site % 5 == 0 or rng.random() < (0.97 if part in (2, 3) and kind < 2 and half else 0.15)
        rows.append((tuple(sorted({"host=all", f"host=s{site}", f"path=a{part}", f"path=b{part}", f"path=h{half}", f"path=k{kind}", f"path=u{i}"})), "block" if bad else "allow"))
    want = _counted(rows, 0.01, 0.8)
    assert len({t for tokens, _ in want for t in tokens}) > 14 and {len(tokens) for tokens, _ in want} >= {1, 2, 3}
    assert _mined(spark, rows, 0.01, 0.8) == want


def test_every_labelled_url_counts(spark):
    """One template holds a third of the urls, and a set of tokens is blocked far more often than allowed."""
    rng = random.Random(7)
    rows = [(("host=ad", "path=x"), "block")] * 300 + [(("host=ad", "path=x"), "allow")] + [(("host=t", "path=y"), "allow")] * 25_000
    rows += [(tuple(sorted({f"host=s{rng.randrange(9)}", f"path=k{rng.randrange(3)}", f"path=u{i}"})), rng.choice(url_rules.VERDICTS)) for i in range(600)]
    want = _counted(rows, 0.01, 0.8)
    assert want[("host=ad",), "block"] == (300 / 301, 300 / len(rows))
    assert _mined(spark, rows, 0.01, 0.8) == want
