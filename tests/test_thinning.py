"""Texts thinned to the lines that matter give the reports of the whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from riskframe.functions.columns import rows_of
from riskframe.plans import file_scan
from riskframe.plans.file_scan import file_reports, with_findings

KEY = "AK" + "IA" + "A" * 16
PIECES = [
    "eval(x)", "exec", "EXEC(v)", "ev'x'al(v)", 'wg""et', "os.system(v)", "subprocess.run(v)", "v = input()", "w = v + 1", "x", "plain words",
    "(", "  (a)", "(", "", "   ", " ", "'", '"', "'''", '"""', "'lit'", "\\", "it\\", "\\'", "def fetch_json(u):", "  def g (u):",
    "urllib.request.urlopen(u)", f'k = "{KEY}"', KEY, "/" * 180, "A" * 90, "+" * 200, "chr(1)+chr(2)", "chr", "base64.b64decode(v)", "bytes.fromhex",
    "İmport subprocess", "socKet", "ſubprocess", "pİckle.load(v)", "ｅval(v)", "ééé prose", "https://a.b",
    "SECRET_PATTERNS = [", "]", "return { why_risky", "}", "explanations = {", "function loadSafeExample() {", "open", "json", "args", "f'", "~", "\U0001f600",
]
JOINS = ["\n", "\n", "\n", "\n", "\n", " ", "", "\r\n", "\r", "\x0b", "\x1c", "\x85", " "]


def _texts(count):
    draw = random.Random(11)
    texts = []
    for i in range(count):
        joins = JOINS[:7] if i % 4 else JOINS
        texts.append("".join(draw.choice(PIECES) + draw.choice(joins) for _ in range(draw.randint(0, 14))))
    return [*texts, "", "\n", "\n\n", "a\n", "exec\n\n (", "exec\nplain\n(", "'a\nexec(b)\n\\\nc'", None]


@pytest.mark.parametrize("call_sites", [False, True])
def test_reports_of_thinned_and_of_whole_texts(spark, monkeypatch, call_sites):
    intents = ["draw it simply", "scan this"]
    rows = spark.createDataFrame(
        [(i, intents[i % 2], t) for i, t in enumerate(_texts(3000))], "file_id int, intent string, content string"
    ).repartition(4, "file_id")

    def reports():
        return {r.file_id: r for r in file_reports(rows, call_sites=call_sites).collect()}

    thin = reports()
    monkeypatch.setattr(file_scan, "_words", lambda *_: None)
    whole = reports()
    assert [i for i in whole if thin[i] != whole[i]] == []
    assert sum(len(r.findings or ()) for r in whole.values()) > 3000


def test_lines_without_a_word_go_no_further(spark):
    """Literals, lower case and searches read the few lines that matter, whatever the length of a text."""
    plain = ["nothing to see on this line"] * 500
    text = "\n".join([*plain, "x = eval(y)", *plain, "it's", "(a)", *plain])
    row = with_findings(spark.createDataFrame([(1, text)], "file_id int, content string")).select(
        "scan_text", "line_code", F.size("all_lines").alias("n"), F.col("all_findings.line").alias("at")
    ).first()
    assert len(row.scan_text) < 4_000 < len(text) and len(row.line_code) < 4_000
    assert row.n == len(text.split("\n")) and set(row.at) == {501}
    assert [line for line in row.scan_text.split("\n") if line != "~"] == ["x = eval(y)", "it's", "(a)"]


def test_rules_without_a_known_word_read_whole_texts(spark):
    from riskframe.rules import BehaviorRule, SecretRule

    rows = spark.createDataFrame([(1, "a plain line\nsome token 1234\nlicense")], "file_id int, content string")
    found = with_findings(rows, behavior=[BehaviorRule("l", "licen[sc]e", 1)], secrets=[SecretRule("[0-9]{4}", "digits", 1)], heuristic=False)
    rows = found.select(F.explode(rows_of("all_findings")).alias("f")).select("f.line").collect()
    assert sorted(r.line for r in rows) == [2, 3]


def test_a_filter_on_findings_copies_no_step(spark):
    rows = spark.createDataFrame([(1, "draw it", "eval(x)")], "file_id int, intent string, content string")
    found = with_findings(rows, call_sites=False).where(F.exists("all_findings", lambda f: f["pattern"] == "eval("))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert found.count() == 1


def test_bytes_that_are_no_text(spark):
    """A file that is no UTF-8 is scanned like any other."""
    text = (b"\xff\xfe" + b"eval(x)\n" + b"\xff\nexec(y)\nv = input()\nos.system(v)").hex()
    rows = spark.range(1).select(
        F.col("id").alias("file_id"), F.lit("draw it").alias("intent"), F.expr(f"cast(unhex('{text}') as string)").alias("content")
    )
    for call_sites in (False, True):
        found = file_reports(rows, call_sites=call_sites).first().findings
        assert [(f.line, f.pattern) for f in found] == [(1, "eval("), (3, "exec("), (5, "os.system")]
        assert "v" in found[2].note
