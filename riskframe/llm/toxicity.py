"""Toxicity: cumulative-link ordinal regression on sparse text features, giving an expected severity.

Features are the words of a text and the first 4, 5 and 6 letters of longer ones, so that inflected and compound forms of a word
share what was learned of it.

Grades are labels: a column of the labels table, or, as it has none, its two columns crossed: 0 for texts labelled not toxic, 1 for
toxic ones, 2 for toxic ones that are labelled of low quality as well. The model has one weight per feature, shared
by all thresholds: ``P(grade <= k) = sigmoid(threshold_k - w . x)``, with ``x`` the presence of each feature. The expected severity is
the sum of ``P(grade > k)``; a text is toxic when ``P(grade > 0)`` is at least one half.

The model is fitted on at most ``max_labelled`` labelled texts (chosen by a hash of the id; several labels of one id count as the
highest one, several texts as the smallest one, null labels do not count); its features are all those that tell the classes apart
beyond chance there. Everything else covers all texts. Equal texts with equal labels count once in training. Without toxic or
without clean labels nothing is toxic and every severity is 0. Null texts count as empty, texts of any length are scored one at a
time, an empty table gives no rows, rows that repeat an id are scored each on their own. Extra columns are ignored, whatever their
names, or kept where documents are returned.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import packed, small_batches, table, unpacked, whole_text, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRADES = 3
MAX_LABELLED = 20_000
PENALTY = 0.1
#: Texts of the sample that a feature must occur in.
MIN_TEXTS = 5
#: How many times as frequent as in all texts a feature is in toxic ones, or the other way round.
MIN_LIFT = 3.0
#: Standard errors that its shares of the two classes lie apart by.
MIN_ERRORS = 5.0

PREFIXES = (4, 5, 6)
_WORD = re.compile(r"\w+")

def features_of(words: list[str]) -> set[str]:
    """The distinct words and their beginnings (marked with a star)."""
    distinct = set(words)
    return distinct.union(*({f"{w[:n]}*" for w in distinct if len(w) > n} for n in PREFIXES))


@dataclass
class OrdinalModel:
    """Weights of the features and ascending thresholds."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, 30.0))

    def exceed(self, text: str) -> np.ndarray:
        """``P(grade > k)`` for each threshold."""
        if not self.weights:
            return np.zeros(len(self.thresholds))
        score = sum(self.weights.get(word, 0.0) for word in features_of(_WORD.findall(text.lower())))
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -30, 30)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, n_columns: int, grades: np.ndarray, n_grades: int, penalty: float = PENALTY, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of largest penalised likelihood; ``rows``, ``columns`` hold the features present in each text.

    The thresholds are a first one and the logarithms of the gaps between them, so that they stay in order.
    """
    n = len(grades)
    params = np.zeros(n_columns + n_grades - 1)
    share = np.clip([(grades > k).mean() for k in range(n_grades - 1)], 1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + np.arange(n_grades - 1) * 1e-3)
    params[n_columns] = start[0]
    params[n_columns + 1 :] = np.log(np.maximum(np.diff(start), 1e-2))
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, gaps = params[:n_columns], np.exp(params[n_columns + 1 :])
        cuts = np.concatenate([[-np.inf], params[n_columns] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(rows, weights=w[columns], minlength=n)
        upper, lower = (1 / (1 + np.exp(-np.clip(cuts[g] - score, -30, 30))) for g in (grades + 1, grades))
        upper, lower = np.where(grades + 1 == n_grades, 1.0, upper), np.where(grades == 0, 0.0, lower)
        chance = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        d_score = d_upper - d_lower  # of the negative log-likelihood
        gradient = np.empty_like(params)
        gradient[:n_columns] = np.bincount(columns, weights=d_score[rows], minlength=n_columns) + penalty * w
        d_cut = np.bincount(grades, weights=-d_upper, minlength=n_grades)[:-1] + np.bincount(grades, weights=d_lower, minlength=n_grades)[1:]
        gradient[n_columns] = d_cut.sum()
        gradient[n_columns + 1 :] = np.cumsum(d_cut[::-1])[::-1][1:] * gaps
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        params -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(params[n_columns + 1 :])
    return params[:n_columns], params[n_columns] + np.concatenate([[0.0], np.cumsum(gaps)])


def label_grades() -> Column:
    """The grade of a row of ``labels``: toxic or not, and of low quality besides."""
    low = F.coalesce(F.col("quality").cast("int"), F.lit(1)) <= 0
    return F.when(F.col("toxic").cast("int") > 0, F.when(low, 2).otherwise(1)).when(F.col("toxic").isNotNull(), 0)


def _training_words(documents: DataFrame, labels: DataFrame, max_labelled: int, grade: Column) -> DataFrame:
    """``grade``, ``words`` (features) of the labelled sample, equal texts of equal grades once."""
    sample = labels.select(F.col("doc_id").cast("long").alias("label_id"), grade.cast("int").alias("grade")).filter("label_id is not null and grade is not null")
    sample = sample.groupBy("label_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)
    texts = documents.select(F.col("doc_id").cast("long").alias("label_id"), whole_text("text").alias("text")).join(F.broadcast(sample), "label_id")
    texts = texts.groupBy("label_id").agg(F.max("grade").alias("grade"), F.min("text").alias("text")).select("grade", "text")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features_of(_WORD.findall(text.lower()))) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"grade": batch.column(0), "words": pa.array(found, pa.list_(pa.string()))})

    return texts.mapInArrow(parts, "grade int, words array<string>").distinct()


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, grade: Column | None = None, n_grades: int = GRADES) -> OrdinalModel:
    """The model of the labelled texts. ``grade``: a column of ``labels`` with grades from 0, which means not toxic, to ``n_grades - 1``."""
    small_batches(documents.sparkSession)
    sample = written(_training_words(documents, labels, max_labelled, label_grades() if grade is None else grade), "sample")
    sizes = dict(sample.groupBy(F.col("grade") > 0).count().collect())
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return OrdinalModel()
    # The features that set the classes apart: much more or much less frequent in toxic texts, by the score of a two-proportion
    # test with pooled variance. Features of a language or a topic that lean to one class only a little are left out.
    numbered = written(sample.select(F.monotonically_increasing_id().alias("n"), "grade", "words"), "numbered")
    present = numbered.select("n", "grade", F.explode("words").alias("word"))
    toxic = F.sum((F.col("grade") > 0).cast("int"))
    rate = F.col("n_texts") / (n_toxic + n_clean)
    apart = F.col("n_toxic") / n_toxic - (F.col("n_texts") - F.col("n_toxic")) / n_clean
    scored = present.groupBy("word").agg(F.count("*").alias("n_texts"), toxic.alias("n_toxic")).filter(F.col("n_texts") >= min(MIN_TEXTS, n_toxic))
    errors = apart / F.sqrt(rate * (1 - rate) * (1 / n_toxic + 1 / n_clean) + 1e-12)
    lift = F.col("n_toxic") / F.col("n_texts") * ((n_toxic + n_clean) / n_toxic)
    scored = scored.filter(((lift >= MIN_LIFT) | (lift <= 1 / MIN_LIFT)) & (F.abs(errors) >= min(MIN_ERRORS, np.sqrt(n_toxic))))
    chosen = written(scored.select("word"), "features")
    # The sample is bounded, and so is what the driver gathers of it.
    words = sorted(r["word"] for r in chosen.collect())
    position = {word: i for i, word in enumerate(words)}
    hits = numbered.join(present.join(chosen, "word").groupBy("n").agg(F.collect_list("word").alias("hits")), "n", "left")
    rows, columns, grades = [], [], []
    for i, (own, found) in enumerate(hits.select("grade", "hits").orderBy("n").toLocalIterator()):
        rows += [i] * len(found or [])
        columns += [position[word] for word in found or []]
        grades.append(min(max(own, 0), n_grades - 1))
    weights, thresholds = fit_ordinal(np.array(rows, np.int64), np.array(columns, np.int64), len(position), np.array(grades), n_grades)
    return OrdinalModel({word: float(weights[i]) for word, i in position.items()}, thresholds)


def severity(model: OrdinalModel, text: str | Column) -> Column:
    """``expected`` severity and ``p_toxic`` of each text."""

    def scored(texts: pa.Array) -> pa.Array:
        chances = [model.exceed(x) for x in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([float(c.sum()) for c in chances], pa.float64()), pa.array([float(c[0]) for c in chances], pa.float64())], names=["expected", "p_toxic"])

    return F.arrow_udf(scored, "expected double, p_toxic double")(whole_text(text))


def toxicity(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, grade: Column | None = None, n_grades: int = GRADES) -> DataFrame:
    """``doc_id``, ``severity`` (0 to ``n_grades - 1``), ``p_toxic``, ``toxic`` of every document."""
    model = fit(documents, labels, max_labelled, grade, n_grades)
    found = documents.select("doc_id", severity(model, "text").alias("found"))
    return found.select("doc_id", F.col("found.expected").alias("severity"), F.col("found.p_toxic").alias("p_toxic"), (F.col("found.p_toxic") >= 0.5).alias("toxic"))


def clean_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    model = fit(documents, labels)
    rows = packed(documents).withColumn("found", severity(model, F.col("row.text")))
    return unpacked(rows.filter(F.col("found.p_toxic") < 0.5))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document with its expected severity, by the model of the labelled ones."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
