"""Plans whose work follows the input: nothing is computed twice, and no task holds what all should share."""

import random
import re

import pytest
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.functions import patterns
from riskframe.functions.columns import held_words, matches_any, rows_of, starting_words
from riskframe.functions.text import split_lines
from riskframe.operators import taint
from riskframe.plans import catalog, file_scan
from riskframe.sources import fixtures


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_advisory_lines_are_parsed_once(spark, small):
    for query in (catalog.advisory_json, catalog.advisory_json_refs, catalog.advisory_bad_lines):
        assert _plan(query(spark, small)).count("parseJson") == 1


def test_parts_of_one_split_go_to_all_cores(spark, small):
    cores = spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{small}/part.parquet").rdd.getNumPartitions() < cores
    assert fixtures.table(spark, small, "part").rdd.getNumPartitions() == cores


def test_a_sort_of_reports_does_not_scan_the_files_twice(spark, small):
    lines = catalog.ranked_files(spark, small)._jdf.queryExecution().executedPlan().toString().split("\n")
    at = {word: next(i for i, line in enumerate(lines) if word in line) for word in ("rangepartitioning", "hashpartitioning", "ArrowEvalPython")}
    assert at["rangepartitioning"] < at["hashpartitioning"] < at["ArrowEvalPython"]


def test_whole_texts_meet_no_alternation_of_many_words(spark):
    """A pattern of many branches costs its branches at every character; plain searches stand before it."""
    files = spark.createDataFrame([(1, "draw it", "x = 1")], "file_id int, intent string, content string")
    plan = _plan(file_scan.file_reports(files))
    for words in ("loadSafeExample\\(|", "urlopen|urlretrieve|[^", "os\\.system|subprocess|child\\_process|requests"):
        assert words not in plan


@pytest.mark.parametrize("end", ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"])
def test_lines_with_and_without_rare_breaks(spark, end):
    text = f"a{end}\n{end}b{end}"
    row = spark.createDataFrame([(text,)], "t string").select(split_lines(F.col("t")).alias("l")).first()
    assert row.l == text.splitlines()


def test_lines_of_hints_of_their_file_only(spark):
    """Each rule finds its line whatever other rules the file holds; a file of one secret needs no hint."""
    lines = ["eval(x)", "plain", 'k = "AK' + "IA" + "A" * 16 + '"', "os.system(y)", "'eval(z)'", "wget it"]
    files = spark.createDataFrame(
        [(0, "\n".join(lines))] + [(i, line) for i, line in enumerate(lines, 1)], "file_id int, content string"
    )
    found = file_scan.with_findings(files, call_sites=False, heuristic=False)
    rows = found.select("file_id", F.explode(rows_of("all_findings")).alias("f")).select("file_id", "f.line", "f.pattern").collect()
    whole = sorted((r.line, r.pattern) for r in rows if r.file_id == 0)
    assert whole == sorted((r.file_id, r.pattern) for r in rows if r.file_id > 0)
    assert [line for line, _ in whole] == [1, 3, 4, 6]


def test_own_sources_need_no_known_word(spark):
    files = spark.createDataFrame([(1, "v = take_it()\nw = v")], "file_id int, content string")
    assert [r.variable for r in taint.taint_map(files, [r"\btake_it\s*\("]).orderBy("pos").collect()] == ["v", "w"]
    assert taint.taint_map(files).count() == 0


def test_sizes_of_a_bucket_are_read_without_its_contents(spark, small):
    plan = catalog.bucketed_repo_files(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "Bucketed: true" in plan


def test_requirement_lines_are_stripped_once_and_behind_the_shuffle(spark, small):
    lines = _plan(catalog._dependencies(spark, small)).split("\n")
    dealt = next(i for i, line in enumerate(lines) if "RepartitionByExpression" in line)
    assert not any("regexp" in line for line in lines[dealt:])


def test_each_word_is_searched_once_in_each_form_of_a_text(spark):
    files = spark.createDataFrame([(1, "draw it", "x = 1")], "file_id int, intent string, content string")
    plan = _plan(file_scan.file_reports(files, call_sites=False))
    counts = {w: len(re.findall(rf"Contains\([^()]*, {re.escape(w)}\)", plan)) for w in ("exec", "subprocess", "fetch", "wget", "chr")}
    assert all(1 <= n <= 2 for n in counts.values()), counts


def test_words_held_and_patterns_found_alone(spark):
    words = ["open", "shelve.open", "exec", "xec", "ab", "abc", "zabcd", "é", "a b"]
    texts = ["", "shelve.open", "open shelve.", "xe exec", "zabcd", "za bc d", "été", "pen ab", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = [r.w for r in rows.select("i", held_words(F.col("t"), words).alias("w")).orderBy("i").collect()]
    assert [sorted(w) for w in found] == [sorted(w for w in words if t and w in t) for t in texts]

    pattern = r"(?<![\w.])exec\s*\(|https?://|\b(curl|wget)\b|[ab]+c|\.write\s*\(|x{2}|a[|]b"
    assert patterns.branches(pattern) == [
        r"(?<![\w.])exec\s*\(", "https?://", r"\b(curl|wget)\b", "[ab]+c", r"\.write\s*\(", "x{2}", "a[|]b",
    ]
    assert [patterns.starts(b) for b in patterns.branches(pattern)] == [["exec"], ["http"], ["curl", "wget"], [], [".write"], [], ["a"]]
    assert patterns.branches("(?i)a|b") == ["(?i)a|b"] and patterns.starts("(?i)a|b") == []
    draw = random.Random(7)
    pieces = ["exec", "(", "http", "s://", "://", "curl", "wget", " ", ".write", "a", "b", "c", "xx", "|", "_", "é", "x"]
    texts = ["".join(draw.choices(pieces, k=draw.randint(0, 5))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    held = held_words(F.col("t"), starting_words([pattern]))
    got = rows.select("i", matches_any(F.col("t"), [pattern]).alias("a"), matches_any(F.col("t"), [pattern], held).alias("b")).orderBy("i").collect()
    want = [bool(re.search(pattern, t)) for t in texts]
    assert [r.a for r in got] == want and [r.b for r in got] == want and 100 < sum(want) < 1400


def test_long_runs_are_found_at_any_place(spark):
    size = rules.BLOB_LENGTH
    texts = [" " * lead + "A" * n + tail for lead in (0, 1, 7, size // 2 - 1, size // 2, size - 1, 1000) for n in (size - 1, size, 3 * size) for tail in ("", " b")]
    texts += ["é " + "\U0001f600" * 91 + "/" * size, "word and " * 400_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file_id int, content string")
    found = file_scan.with_findings(rows, call_sites=False)
    got = {r.file_id for r in found.where(F.exists("all_findings", lambda f: f["pattern"] == "high_entropy_blob")).select("file_id").collect()}
    assert got == {i for i, t in enumerate(texts) if re.search(rf"[A-Za-z0-9+/]{{{size}}}", t)} and len(got) == 29


def test_words_that_stand_only_without_a_literal(spark):
    """A literal may stand inside a word, and one that spans lines hides words of the whole text only."""
    texts = ["ev'x'al(y)", "s = 'a\nexec(b)\nc'", "wg''et", "'a\n' subprocess"]
    files = spark.createDataFrame([(i, "draw it", t) for i, t in enumerate(texts)], "file_id int, intent string, content string")
    rows = file_scan.file_reports(files, call_sites=False).orderBy("file_id").select("touches", F.col("findings.pattern").alias("p")).collect()
    assert [(r.touches, r.p) for r in rows] == [
        (["system execution"], ["eval("]), ([], ["exec("]), (["network"], ["download helper"]), (["system execution"], ["subprocess"]),
    ]
