"""Files stored in parts against the same files as one text."""

import random

import pytest
from pyspark.sql import functions as F

from riskframe.operators import detect, parts
from riskframe.operators.lines import line_explode, scannable_lines, strip_literals_per_line, with_scannable

BREAKS = ["\n"] * 12 + ["\r\n", "\r", "\x0b", "\x85", " ", "\r\r\n", "\n\n"]
PIECES = [
    "SUSPICIOUS_PATTERNS = [", "SECRET_PATTERNS = [", "]", "],", "DEPENDENCY_SEVERITY_POINTS = {", "DEPENDENCY_MANIFEST_FILES = {", "}",
    "explanations = {", "return { why_risky", "return { why_risky }", "return { why_risky }}", "}}", "{", "{{", "x = {}", "function loadSafeExample() {",
    "function loadSecretExample()", "  function loadSafeExample() {}", "def f(a):", "  def g(", "text", "", "  ", "'a' + \"b\"", "é {",
]


def _files(seed, n=25):
    rng = random.Random(seed)
    texts = ["", "\n", "\r\n", "\r", "a", "a\r\nb", "no break " * 30]
    texts += ["".join(rng.choice(PIECES) + rng.choice(BREAKS) for _ in range(rng.choice([2, 10, 60]))) + rng.choice(["", "end"]) for _ in range(n)]
    return list(enumerate(texts))


@pytest.mark.parametrize("size", [1, 2, 7, 40, 100_000])
def test_parts_equal_whole_files(spark, size, monkeypatch):
    monkeypatch.setattr(parts, "LINE_BLOCK", 5)
    files = spark.createDataFrame(_files(size), "file_id long, content string").repartition(4).cache()
    pieces = parts.cut(files, size)
    lines = parts.line_rows(pieces).cache()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(lines) == rows(line_explode(files).select("file_id", "line_no", "line"))
    kept = parts.scannable_rows(lines).cache()
    assert rows(kept) == rows(scannable_lines(files).select("file_id", "line_no", "line"))
    assert rows(parts.function_rows(kept)) == rows(detect.enclosing_function_rows(with_scannable(files)))
    assert rows(parts.code_rows(lines).select("file_id", "line_no", "code")) == rows(strip_literals_per_line(files.where("content <> ''")))
    for df in (files, lines, kept):
        df.unpersist()


def test_parts_of_nothing(spark):
    empty = spark.createDataFrame([], "file_id long, part_no int, content string")
    lines = parts.line_rows(empty)
    assert lines.count() == parts.scannable_rows(lines).count() == parts.function_rows(lines).count() == 0


def test_one_hot_file_is_dealt_out(spark):
    """A file of half a million lines: no task gathers its text, only narrow rows and lines that cross parts are shuffled."""
    text = F.concat(F.lit("def f"), F.col("id").cast("string"), F.lit("():\n"), F.repeat(F.lit("  body {\n  }\n"), 10), F.lit("  cut"))
    pieces = spark.range(25_000).select(F.lit(1).alias("file_id"), F.col("id").cast("int").alias("part_no"), text.alias("content")).repartition(8)
    lines = parts.line_rows(pieces)
    assert lines.count() == 25_000 * 21 + 1
    found = parts.function_rows(parts.scannable_rows(lines))
    # A part's first line is glued to the open end of the part before, so only the first def stands at a line's start.
    assert found.agg(F.count("*"), F.count_distinct("function"), F.max("line_no")).first() == (525_001, 1, 525_001)


def test_a_file_stays_in_one_task_behind_a_join_by_file(spark):
    """Spark drops a distribution by the join's own key, and adaptive execution may then read the join's partitions in pieces."""
    lines = spark.createDataFrame([(1, 1, "explanations = {"), (1, 2, "}")], "file_id long, line_no int, line string").repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranges = parts.excluded_ranges(lines)
        assert "REPARTITION_BY_COL" in ranges._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in ranges.collect()] == [(1, 1, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
