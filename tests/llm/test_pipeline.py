"""Each stage of the pipeline on what the one before kept, against plain versions."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from riskframe.llm import toxicity
from tests.llm.brute import LOWER, components, shingles, words
from tests.llm.test_mixing import _targets
from tests.llm.test_packing import _used


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, found = spark.read.parquet(f"{small}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        rows = out.collect()
        found.append((docs, docs.collect(), out, rows))
        docs = spark.createDataFrame(rows, out.schema)
    return found


def test_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "MinHash near-dedup", "source mixing", "best-fit packing"]
    for docs, _, out, _ in stages[:-1]:
        assert out.columns == docs.columns


def test_toxic_documents_go(spark, small, stages):
    docs, before, _, after = stages[0]
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    assert sorted(after) == sorted(r for r in before if model.exceed(r["text"] or "")[0] < 0.5)
    assert 0.7 * len(before) < len(after) < len(before)


def test_copies_go(stages):
    _, before, _, after = stages[1]
    largest = {}
    for r in before:
        key = (r["text"] or "").translate(LOWER)
        largest[key] = max(largest.get(key, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(largest.values())


def test_near_copies_go(stages):
    _, before, _, after = stages[2]
    before = sorted(before, key=lambda r: r["doc_id"])
    roots = components([shingles(r["text"], 5) for r in before], 80)
    assert sorted(after) == sorted(r for i, r in enumerate(before) if roots[i] == i)


def test_sources_are_mixed(stages):
    _, before, _, after = stages[3]
    size, sizes, taken = {}, {}, {}
    for r in before:
        size[r["doc_id"]] = len(words(r["text"]))
        sizes[r["source"]] = sizes.get(r["source"], 0) + size[r["doc_id"]]
    held = {}
    for r in after:
        n = len(words(r["text"]))
        taken[r["source"]] = taken.get(r["source"], 0) + n
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + n
    assert all(n <= 2 * size[i] for i, n in held.items())
    assert all(abs(taken.get(s, 0) - target) <= 48 for s, (target, _) in _targets(sizes).items())


def test_everything_is_packed(stages):
    _, before, _, after = stages[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before)
    used = _used(after)
    assert sum(used.values()) == total and max(used.values()) <= 2048
    assert len(used) <= -(-total // 2048) + 3


def test_queries_are_registered(spark, small):
    names = list(driver.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(driver.oracle_sql()) <= set(names)
    assert driver.queries()["pipeline"](spark, small).columns[0] == "doc_id"
