"""Severity grades that labels give, and the ordinal model against a plain version."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from riskframe.llm import toxicity
from tests.llm.brute import documents

LABELS = "doc_id long, quality int, toxic int"


def _graded(n, seed):
    """Texts with marks of two kinds; labels call those with the second kind low in quality as well."""
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        grade = 0 if i % 3 else 1 + (i % 2)
        text = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(1, 4) if grade else 0):
            text.insert(rng.randrange(len(text)), rng.choice([["grub", "snarl"], ["vile", "fiend"]][grade - 1]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(grade < 2), int(grade > 0)))
    return rows, labels


def _features(text):
    words = re.findall(r"\w+", text.lower())
    return set(words) | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) > n}


def _loss(model, names, weights, cuts, sample):
    total = 0.05 * sum(w * w for w in weights)
    for grade, found in sample:
        score = sum(weights[names[f]] for f in found if f in names)
        upper = 1.0 if grade == len(cuts) else 1 / (1 + math.exp(-(cuts[grade] - score)))
        lower = 0.0 if grade == 0 else 1 / (1 + math.exp(-(cuts[grade - 1] - score)))
        total -= math.log(max(upper - lower, 1e-12))
    return total


def test_model_equals_a_plain_version(spark):
    rows, labels = _graded(240, 1)
    model = toxicity.fit(documents(spark, rows).repartition(3), spark.createDataFrame(labels, LABELS))
    sample = list({(0 if not t else 2 - q, frozenset(_features(text))) for (_, text), (_, q, t) in zip(rows, labels, strict=True)})
    n_toxic, n_clean = sum(g > 0 for g, _ in sample), sum(g == 0 for g, _ in sample)
    counts = {}
    for grade, found in sample:
        for f in found:
            a, b = counts.get(f, (0, 0))
            counts[f] = (a + 1, b + (grade > 0))
    chosen = set()
    for f, (n, toxic) in counts.items():
        rate, lift = n / len(sample), toxic / n * len(sample) / n_toxic
        errors = (toxic / n_toxic - (n - toxic) / n_clean) / math.sqrt(rate * (1 - rate) * (1 / n_toxic + 1 / n_clean))
        if n >= toxicity.MIN_TEXTS and (lift >= toxicity.MIN_LIFT or lift <= 1 / toxicity.MIN_LIFT) and abs(errors) >= toxicity.MIN_ERRORS:
            chosen.add(f)
    assert set(model.weights) == chosen and chosen >= {"grub", "vile"}
    names = {f: i for i, f in enumerate(model.weights)}
    weights, cuts = list(model.weights.values()), list(model.thresholds)
    best, rng = _loss(model, names, weights, cuts, sample), random.Random(2)
    for _ in range(200):  # no step away from the fit is better by more than half a per cent
        step = rng.choice([0.02, 0.1, 0.5])
        moved = [w + rng.gauss(0, step) * (rng.random() < 0.5) for w in weights]
        moved_cuts = sorted(c + rng.gauss(0, step) * (rng.random() < 0.5) for c in cuts)
        assert _loss(model, names, moved, moved_cuts, sample) > 0.995 * best


def test_severity_follows_the_labels_on_held_out_texts(spark):
    rows, labels = _graded(900, 3)
    train = spark.createDataFrame([x for x in labels if x[0] // 6 % 2], LABELS)
    got = {r["doc_id"]: r["severity"] for r in toxicity.toxicity(documents(spark, rows), train).collect()}
    held = {g: [got[i] for i, q, t in labels if i // 6 % 2 == 0 and (0 if not t else 2 - q) == g] for g in range(3)}
    means = [float(np.mean(held[g])) for g in range(3)]
    assert abs(means[0]) < 0.2 and abs(means[1] - 1) < 0.3 and abs(means[2] - 2) < 0.3, means


def test_grades_of_a_column(spark):
    rows, labels = _graded(300, 4)
    table = documents(spark, [*rows, (5_000, "vile " * 50_000), (None, None)])
    graded = spark.createDataFrame([(i, 0 if not t else 3 if not q else 1, "x") for i, q, t in labels], "doc_id long, severe int, toxic string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(table, graded, grade=F.col("severe"), n_grades=4).collect()}
    assert got[5_000]["toxic"] and 2 < got[5_000]["severity"] <= 3 and got[None]["severity"] < 0.2
