"""File reports: hand-derived cases, properties, plan shape."""

import pytest
from pyspark.sql import functions as F

from riskframe.plans.file_scan import file_reports
from riskframe.sources import fixtures

# snippet -> (points, risk, trust, touches, findings as (line, key, severity))
FULL = {
    0: (0.0, "green", 100, [], []),
    1: (46.0, "red", 54, ["system execution"], [(3, "os.system", 46.0)]),
    2: (29.0, "yellow", 71, ["system execution"], [(1, "eval(", 29.0)]),
    3: (38.0, "red", 62, ["secrets"], [(1, "AKIA[0-9A-Z]{16}", 30.0)]),
    4: (0.5, "green", 100, ["files"], [(1, "open(", 0.5)]),
    5: (26.0, "yellow", 74, ["system execution"], [(1, "subprocess", 15.0), (2, "subprocess", 11.0)]),
    6: (47.5, "red", 52, ["system execution", "obfuscation"],
        [(1, "base64", 0.25), (2, "base64", 0.25), (2, "exec(", 29.0), (2, "obfuscated_execution", 18.0)]),
    7: (57.0, "red", 43, ["network", "system execution"],
        [(2, "requests.get", 2.0), (3, "download_execute_chain", 14.0), (3, "exec(", 41.0)]),
    8: (7.0, "green", 93, ["obfuscation"], [(1, "chr_chain", 7.0)]),
    9: (18.5, "yellow", 82, ["files", "deserialization"], [(1, "open(", 0.5), (1, "yaml.load", 18.0)]),
    10: (6.0, "green", 94, [], [(1, "high_entropy_blob", 6.0)]),
    11: (5.0, "green", 95, ["network"], [(2, "urllib.request.urlopen", 5.0)]),
}


@pytest.fixture(scope="module")
def reports(spark, small):
    rows = file_reports(fixtures.code_files(spark, small)).collect()
    return {r.file_id: r for r in rows}


def test_snippets_match_hand_derived_reports(reports):
    for snippet, (points, risk, trust, touches, found) in FULL.items():
        plain = [r for i, r in reports.items() if (i // 10) % 12 == snippet and i % 3 == 0]
        assert plain
        for r in plain:
            assert (r.risk_points, r.risk, r.trust_score, r.touches) == (points, risk, trust, touches)
            assert [(f.line, f.pattern, f.severity) for f in r.findings] == found


def test_intent_penalties(reports):
    expected = {(7, 1): 60.5, (9, 1): 21.5, (7, 2): 59.5, (9, 2): 20.5}
    for i, r in reports.items():
        key = ((i // 10) % 12, i % 3)
        if key in expected:
            assert r.risk_points == expected[key]


def test_report_properties(reports):
    for r in reports.values():
        keys = [(f.line, f.pattern) for f in r.findings]
        assert len(keys) == len(set(keys)) and keys == sorted(keys)
        assert 0 <= r.trust_score <= 100
        shown = [line.line for b in r.focused_code_blocks for line in b.lines]
        assert len(shown) == len(set(shown))
        assert {f.line for f in r.findings} <= set(shown)
        assert {f.line for f in r.findings} == {
            line.line for b in r.focused_code_blocks for line in b.lines if line.flagged
        }


def test_line_limit(spark):
    rows = spark.createDataFrame(
        [(1, "x", "eval(a)\n" * 4, "free"), (2, "x", "eval(a)\n" * 4, "Pro"), (3, "x", "eval(a)\n" * 4, "admin"),
         (4, "x", "eval(a)\n" * 3, None)],
        "file_id int, intent string, content string, plan string",
    )
    from riskframe.rules import PlanLimits

    limits = {"free": PlanLimits(3, 1, 1, 1), "pro": PlanLimits(3, 1, 1, 1), "admin": PlanLimits(None, None, None, None)}
    got = {r.file_id: r for r in file_reports(rows, call_sites=False, plan_limits=limits).collect()}
    assert got[1].risk == "limit" and got[1].risk_points == 100 and got[1].trust_score == 0 and not got[1].findings
    assert got[1].summary == "Free scans are limited to 3 lines. Pro unlocks larger file scanning."
    assert got[2].summary == "Pro scans are limited to 3 lines right now."
    assert got[3].risk == "red" and got[4].risk == "red"


def test_empty_and_odd_texts(spark):
    texts = ["", "\n", "x = '", "é.eval(1)", "éeval(1)", "eval (1)", 'ev"x"al(1)', "EVAL(x)", "a\x0beval(b)"]
    rows = spark.createDataFrame(
        [(i, "x", t) for i, t in enumerate(texts)], "file_id int, intent string, content string"
    )
    got = {r.file_id: r for r in file_reports(rows, call_sites=False).collect()}
    assert [len(got[i].findings) for i in range(len(texts))] == [0, 0, 0, 0, 0, 1, 1, 1, 1]
    assert got[7].findings[0].severity == 25.0  # arguments are read in the original case
    assert got[8].findings[0].line == 2
    assert got[0].behavior_summary == ["No obvious risky behavior was detected in this scan."]


def test_plan_is_one_pass(spark, small):
    plan = file_reports(spark.read.parquet(f"{small}/documents.parquet").select(
        F.col("doc_id").alias("file_id"), F.lit("x").alias("intent"), F.col("text").alias("content")
    ))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count("ArrowEvalPython") == 1 and plan.count("FileScan") == 1
    # An expensive step appears once: nothing was inlined into a lambda or a second branch.
    assert plan.count("'(?:[^'\\\\\\n]++|\\\\[^\\n])*+'") <= 1


def test_exploding_findings_adds_no_second_evaluation(spark, small):
    from riskframe.operators.findings import finding_rows

    rows = finding_rows(file_reports(fixtures.code_files(spark, small), call_sites=False))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size" not in plan and plan.count("sk-[A-Za-z0-9]{20,} ") <= 2


def test_result_does_not_depend_on_partitions(spark, small):
    files = fixtures.code_files(spark, small)
    show = lambda df: sorted((r.file_id, r.risk_points) for r in df.select("file_id", "risk_points").collect())
    assert show(file_reports(files.coalesce(1))) == show(file_reports(files.repartition(13)))
