"""The fill-in-middle transformation against a plain version."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import fim
from tests.llm.brute import documents, sha

ENDS = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+", "word": r"[^\x20\t-\r]*[\x20\t-\r]|[^\x20\t-\r]+"}


def _plain(doc_id, text, unit="line", rate=100, markers=fim.MARKERS):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    units = re.findall(ENDS[unit], text)
    n = len(units)
    if not text or any(m in text for m in markers) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    pre, suf, mid = markers
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), suf + s + pre + p + mid + m
    return n, "psm", len(p), len(m), pre + p + suf + s + mid + m


def _texts():
    rng = random.Random(3)
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "has <P> inside\nb\n", "ends with <\n<S\n>", "\r\n\x0b\x0c", "ä€😀\nб\n" * 40, "x" * 100_000, "line of words. and more!\n" * 20_000]
    texts += ["".join(rng.choice("ab \n\n.!é😀<S>") for _ in range(rng.choice([3, 63, 64, 65, 500]))) for _ in range(150)]
    return [(rng.choice([None, -i, i, 5]), text) for i, text in enumerate(texts)]


@pytest.mark.parametrize(("unit", "rate"), [("line", 100), ("sentence", 60), ("word", 100)])
def test_transform(spark, unit, rate):
    rows = _texts()
    table = documents(spark, rows).withColumn("output", F.lit("own")).withColumn("row", F.lit(1))
    made = fim.fill_in_middle(table, unit=unit, rate=rate)
    assert set(made.columns) == {*table.columns, "n", "form", "prefix_chars", "middle_chars"}
    got = made.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(((i, t, *_plain(i, t, unit, rate)) for i, t in rows), key=str)
    assert all(r["back"] == (r["text"] or "") for r in got)
    assert {"plain", "spm", "psm"} == {r["form"] for r in got}
    assert fim.fill_in_middle(documents(spark, [])).count() == 0


def test_query_and_sql(spark, tmp_path):
    rows = _texts()
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in fim.op11_fim_transform(spark, str(tmp_path)).collect()]
    want = [(i, *(x := _plain(i, t))[:4], sha(x[4]), sha(t or "")) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(duckdb.sql(fim.OP11_SQL).fetchall(), key=str) == sorted(want, key=str)


def test_wavelet_matrix():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 700):
        symbols = rng.integers(0, 5, n).astype(np.uint8)
        matrix = fim.WaveletMatrix(symbols)
        for symbol in range(5):
            places = np.flatnonzero(symbols == symbol)
            assert [matrix.rank(symbol, at) for at in range(n + 1)] == [int((places < at).sum()) for at in range(n + 1)]
            assert [matrix.select(symbol, k) for k in range(len(places))] == list(places)


def test_markers_must_be_told_apart():
    for markers in (("<P>", "P>x", "<M>"), ("", "a", "b"), ("abc", "b", "d"), ("aXa", "b", "c")):
        with pytest.raises(ValueError, match="markers"):
            fim._checked(markers)
