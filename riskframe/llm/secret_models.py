"""Secret scan: fixed forms, and tokens that a character Markov model of random strings explains better than one of ordinary words.

Both models hold transition counts between character classes (each letter and digit, one class for ``+/_=.-``, one for the ends of
a token). They are trained on labelled samples that one pass over *all* texts collects: the values of the fixed forms are random
strings; purely alphabetic tokens are ordinary identifiers, and so are the names, paths and numbered words that are built from
them (``compounds``), so that digits and separators are no proof of randomness. The counts are tables of fixed size, summed on
the executors.

A candidate is a run of ``min_length`` or more characters of ``[A-Za-z0-9+/_=-]`` that overlaps no fixed form. It is reported as kind
``random`` when its log-likelihood ratio per character is above ``threshold + margin / length``: the shorter, the surer.

Fixed forms, leftmost and non-overlapping for each kind, by the positions of characters (code points), end exclusive; failing
matches are dropped. Null texts count as empty. Without any labelled token of one side no candidate is reported. An empty table
gives no rows; rows that repeat an id or a text are scanned each on their own; texts of any length are held one at a time; of the
columns only a clashing ``found`` is replaced.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import small_batches, table, whole_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("assign", "access", "hex")
MIN_LENGTH, THRESHOLD, MARGIN = 12, 0.8, 14.0
#: Weight of the smoothing of a random string's next character, and how far that is towards even chances.
EVEN_WEIGHT, EVEN_SHARE = 200, 0.5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_GATE = ("passw", "secret", "token", "key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Whole runs: a run of 16 or more is matched from its start, a shorter one would be dropped.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_ORDINARY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{4,}+(?![0-9+/_=-])")

_CLASSES = 64
_CLASS = np.full(256, 62, np.uint8)
for _i, _c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"):
    _CLASS[_c] = _i
_CLASS[ord("\n")] = 63

Span = tuple[str, int, int]


def fixed_spans(text: str) -> list[Span]:
    """``(kind, start, end)`` by start, then kind."""
    spans: list[Span] = []
    lower = text.lower()
    if any(word in lower for word in _ASSIGN_GATE):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_value(text: str, span: Span) -> str:
    """The random part of a fixed form."""
    kind, start, end = span
    return _ASSIGN.match(text, start).group(2) if kind == "assign" else text[start:end]


def candidates(text: str, spans: list[Span], min_length: int) -> list[tuple[int, int]]:
    """Runs that may be secrets, outside the fixed forms."""
    found, starts, ends = [], [s for _, s, _ in spans], list(accumulate((e for *_, e in spans), max))
    for m in re.finditer(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{min_length},}}", text):
        start, end = m.span()
        before = bisect_left(starts, end)
        if not (before and ends[before - 1] > start):
            found.append((start, end))
    return found


def compounds(words: list[str], salt: int) -> list[str]:
    """Ordinary identifiers of several words and small numbers, as names, paths and versions have them; each four words make one."""
    made = []
    for at in range(0, len(words) - 3, 4):
        a, b, c, d = words[at : at + 4]
        draw = (31 * salt + at) % 997
        number = (str(1990 + draw % 40), str(draw % 100), f"{draw % 12 + 1:02d}", str(draw % 1000))[draw % 4]
        by = "_-/"[draw % 3]
        shapes = (f"{a}{by}{b}{by}{number}", f"{a}{by}{number}{by}{b}", f"{a.lower()}{b.capitalize()}{number}", by.join((a, b, c, d)), a + number, f"{number}{by}{a}{by}{b}")
        made.append(shapes[draw % 6])
    return made


def _transitions(tokens: list[str]) -> np.ndarray:
    """Counts of class pairs, ends of tokens included."""
    codes = _CLASS[np.frombuffer(("\n" + "\n".join(tokens) + "\n").encode("ascii", "replace"), np.uint8)].astype(np.int64)
    return np.bincount(codes[:-1] * _CLASSES + codes[1:], minlength=_CLASSES * _CLASSES)


def train(texts: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each transition (random over ordinary), from the tokens of all rows of ``text``; all zero without examples."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, _CLASSES * _CLASSES), np.int64)
        for batch in batches:
            random: list[str] = []
            for text in batch.column(0).to_pylist():
                spans = fixed_spans(text)
                random += [secret_value(text, s) for s in spans]
                words = _ORDINARY.findall(text)
                total[1] += _transitions(words + compounds(words, len(text)))
            total[0] += _transitions(random)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at, pa.int64()), "random": pa.array(total[0][at]), "ordinary": pa.array(total[1][at])})

    counts = np.zeros((2, _CLASSES * _CLASSES))
    for pair, random, ordinary in texts.mapInArrow(counted, "pair long, random long, ordinary long").groupBy("pair").agg(F.sum("random"), F.sum("ordinary")).collect():
        counts[:, pair] = random, ordinary  # 4,096 rows at most
    counts = counts.reshape(2, _CLASSES, _CLASSES)
    counts[:, 63, 63] = 0
    if not counts.any(axis=(1, 2)).all():
        return np.zeros((_CLASSES, _CLASSES))
    # Smoothed towards each model's own character frequencies, and those towards even ones. Random strings are known to be near
    # even, and few are at hand.
    single = counts.sum(axis=1) + 1
    single /= single.sum(axis=1, keepdims=True)
    even = np.full(_CLASSES, 0.98 / 62)
    even[62:] = 0.015, 0.005
    single[0] = (1 - EVEN_SHARE) * single[0] + EVEN_SHARE * even
    weight = np.array([EVEN_WEIGHT, 8])[:, None, None]
    chance = (counts + weight * single[:, None, :]) / (counts.sum(axis=2, keepdims=True) + weight)
    return np.log(chance[0]) - np.log(chance[1])


def ratio(ratios: np.ndarray, token: str) -> float:
    """Log-likelihood ratio per character."""
    codes = _CLASS[np.frombuffer(f"\n{token}\n".encode("ascii", "replace"), np.uint8)]
    return float(ratios[codes[:-1], codes[1:]].sum() / len(token))


def scan(rows: DataFrame, min_length: int = MIN_LENGTH, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """``rows`` with ``found``: an array of ``kind, start, end, value, score`` by start, then kind (``random`` last)."""
    small_batches(rows.sparkSession)
    ratios = train(rows.select(whole_text("text").alias("text")))
    known = bool(ratios.any())

    def spans(texts: pa.Array) -> pa.Array:
        found = []
        for text in texts.to_pylist():
            fixed = fixed_spans(text)
            out = [{"kind": k, "start": s, "end": e, "value": text[s:e], "score": ratio(ratios, secret_value(text, (k, s, e))) if known else None} for k, s, e in fixed]
            for s, e in candidates(text, fixed, min_length) if known else []:
                if (score := ratio(ratios, text[s:e])) > threshold + margin / (e - s):
                    out.append({"kind": "random", "start": s, "end": e, "value": text[s:e], "score": score})
            found.append(sorted(out, key=lambda x: (x["start"], (*KINDS, "random").index(x["kind"]))))
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("score", pa.float64())])
        return pa.array(found, pa.list_(item))

    find = F.arrow_udf(spans, "array<struct<kind:string,start:long,end:long,value:string,score:double>>")
    return rows.withColumn("found", find(whole_text("text")))


def span_list(found: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(documents: DataFrame, min_length: int = MIN_LENGTH, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """``doc_id``, the number of fixed forms of each kind, their digest, and all spans."""
    found = scan(documents.select("doc_id", "text"), min_length, threshold, margin).select("doc_id", "found")
    fixed = F.filter("found", lambda s: s["kind"] != "random")
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [(F.size("found") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_list(fixed), 256).alias("base_sha256"), span_list(F.col("found")).alias("spans"))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every document with the secrets of its whole text."""
    return digest(table(spark, sf_dir, "documents"))
