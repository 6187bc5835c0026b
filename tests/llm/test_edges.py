"""Odd inputs of operators and of the whole pipeline: nulls, empty and very long texts, repeats, clashing column names, no rows."""

import pytest

import corpus_pipeline
from riskframe.llm import chat, url_rules
from tests.llm.brute import documents

LONG = " ".join(f"word{i % 997}" for i in range(120_000))
ROWS = [
    (1, None), (1, None), (2, ""), (3, "  \n "), (None, "no id here at all"), (None, "no id here at all"), (4, LONG, "big"), (5, LONG + " more", "big"),
    (6, "one two three", None), (6, "one two three", None), (7, "ONE two three", None), (8, "é😀\n" * 50, ""), (9, "x" * 50_000, "b"),
]


def _stages(spark, small, rows):
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        got = out.collect()
        yield name, docs, out, got
        docs = spark.createDataFrame(got, out.schema)


def test_pipeline_on_odd_rows(spark, small):
    found = {name: (docs, out, got) for name, docs, out, got in _stages(spark, small, ROWS)}
    for name, (docs, out, got) in list(found.items())[:-1]:
        assert out.columns == docs.columns, name
        assert all(r["digest"] == r["kept"] == "own" for r in got)
    assert len(found["toxicity"][2]) == len(ROWS)
    assert sorted(((r["doc_id"], (r["text"] or "")[:9]) for r in found["exact dedup"][2]), key=str) == sorted(
        [(2, ""), (3, "  \n "), (None, "no id her"), (4, LONG[:9]), (5, LONG[:9]), (7, "ONE two t"), (8, ("é😀\n" * 3)), (9, "x" * 9)], key=str)
    assert {r["doc_id"] for r in found["MinHash near-dedup"][2]} == {2, 3, None, 4, 7, 8, 9}
    packed = found["best-fit packing"][2]
    assert all(0 < r["length"] <= 2048 and r["offset"] + r["length"] <= 2048 for r in packed)


def test_pipeline_on_nothing(spark, small):
    assert all(got == [] for _, _, _, got in _stages(spark, small, []))


def test_urls_that_are_odd(spark):
    schema = "page_id long, url string, host string, rule string, verdict string, row string"
    urls = ["https://b.com/de/" + "a" * 200_000, "https://b.com/fr/x", "https://b.com/fr/x", None, "", "https://example.org/es/1"]
    rows = spark.createDataFrame([(i % 4, u, "own", "own", "own", "own") for i, u in enumerate(urls)], schema)
    got = sorted((r["page_id"], r["host"], r["rule"] or "", r["verdict"]) for r in url_rules.judge(rows).collect())
    assert [g[:3] for g in got] == sorted([(0, "b.com", "com/de/"), (1, "b.com", "com/fr/"), (2, "b.com", "com/fr/"), (3, "", ""), (0, "", ""), (1, "example.org", "example.org/es/")])
    assert all(v == ("block" if rule in ("com/de/", "example.org/es/") else "allow") for _, _, rule, v in got)
    assert url_rules.judge(rows.limit(0)).count() == 0


@pytest.mark.parametrize("extra", ["place", "h1", "n_turns"])
def test_chats_of_long_texts(spark, extra):
    long = "é" * 300_000
    rows = spark.createDataFrame([(1, 0, "user", long, "own"), (1, 1, "assistant", "ok", "own"), (2, 0, "user", long, "own"), (2, 0, "user", long, "own")], f"conv_id long, turn long, role string, text string, {extra} string")
    got = sorted((r["conv_id"], r["place"], r["n_logged"], len(r["rendered"])) for r in chat.format_chats(rows).collect())
    frame = sum(map(len, chat.TEMPLATE))
    assert got == [(1, 1, 1, frame + 4 + 300_000), (1, 2, 1, frame + 9 + 2)]
