"""The file queries read the documents' own text, not only the snippet before it."""

from riskframe.plans import catalog

CALLS = {3: [2, 5], 4: [1], 8: [4_000]}  # lines of a document's text with a call


def _documents(spark, path):
    texts = []
    for i in range(10):  # all with the snippet of one line, print(1)
        n = max(CALLS.get(i, [6]))
        texts.append((i, "\n".join(f"eval(v{j})" if j in CALLS.get(i, []) else f"wörds {j}" for j in range(1, n + 1)), "en"))
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return texts


def test_hits_inside_texts_are_found(spark, tmp_path):
    texts = _documents(spark, tmp_path)
    whole = {i: f"print(1)\n# {lang} {i}\n# " + text.replace("\n", "\n# ") for i, text, lang in texts}
    sizes = {r.file_id: r.size_bytes for r in catalog.scan_files(spark, str(tmp_path)).collect()}
    assert sizes == {i: len(text.encode()) for i, text in whole.items()}
    found = {(r.file_id, r.line) for r in catalog.behavior_findings(spark, str(tmp_path)).collect() if r.pattern == "eval("}
    want = {(i, n) for i, text in whole.items() for n, line in enumerate(text.split("\n"), 1) if "eval(" in line}
    assert len(want) == 4 and found == want
    # One finding is kept for each line and key, in the batch and in the stream.
    for query in (catalog.file_report, catalog.stream_scan):
        counts = {r.file_id: r.finding_count for r in query(spark, str(tmp_path)).collect()}
        assert counts == {i: len(CALLS.get(i, [])) for i in whole}
