"""Manifests, advisories, repositories, quota and streams."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from riskframe.functions.paths import repo_of_url
from riskframe.functions.scores import risk_level
from riskframe.functions.versions import normalize_version
from riskframe.operators import dependencies, limits, manifests, quota, ranking, repo
from riskframe.plans import repo_scan
from riskframe.plans.file_scan import file_reports
from riskframe.rules import PlanLimits
from riskframe.sources import advisories as advisory_source
from riskframe.sources import files as file_source
from riskframe.sources import fixtures, sinks
from riskframe.streaming import jobs


def test_versions(spark):
    cases = {
        "^1.2.3": ("1.2.3", "range-normalized"), "~2.0": ("2.0", "range-normalized"), "1.2.3": ("1.2.3", "exact"),
        "=1.0": ("1.0", "exact"), "~=1.4": ("=1.4", "range-normalized"), "==v2.0": ("2.0", "exact"),
        "latest": (None, "unresolved"), "workspace:*": (None, "unresolved"), "1.0 - 2.0": (None, "unresolved"),
        "1 || 2": (None, "unresolved"), "1.x": (None, "unresolved"), "": (None, "unresolved"),
        "1.0.0-next.1": (None, "unresolved"), "^": (None, "unresolved"), " '1.0' ": ("1.0", "exact"),
        "GIT+ssh://a": (None, "unresolved"), None: (None, "unresolved"),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw string")
    for r in rows.select("raw", normalize_version(F.col("raw")).alias("n")).collect():
        assert (r.n.version, r.n.kind) == cases[r.raw], r.raw


def test_requirements(spark):
    text = [
        "pkg1==1.2.3", "pkg1~=1.4", "pkg1>=2.0", "pkg1", "# note", 'pkg1[extra]==v2.0 ; python_version>"3"', "-r base.txt",
        "pkg1 1.0", "pkg1==1.*", "", "  ", "@bad", "a @ https://h/x", "--index-url https://h", "x==1 # c", "; y",
    ]
    files = spark.createDataFrame([("r", "top/dev-requirements.txt", "\n".join(text))], "repo string, path string, content string")
    got = {r.line: r for r in manifests.manifest_entries(files).collect()}
    good = {k: (r.package, r.version, r.version_kind) for k, r in got.items() if r.reason is None}
    assert good == {
        1: ("pkg1", "1.2.3", "exact"), 2: ("pkg1", "=1.4", "range-normalized"), 6: ("pkg1", "2.0", "exact"),
        8: ("pkg1", "1.0", "exact"), 15: ("x", "1", "exact"),
    }
    bad = {k: r.reason.split()[0] for k, r in got.items() if r.reason}
    assert bad == {3: "Complex", 4: "Unpinned", 7: "Nested,", 9: "Complex", 12: "Could", 13: "Complex", 14: "Complex"}
    assert len(got) == 12


def test_package_json(spark):
    texts = [
        '{"dependencies":{"a":"^1.2.3","b":null,"a2":"latest"},"peerDependencies":[1],"devDependencies":{"c":" 1.0 "}}',
        "{broken", '{"name":"n"}',
    ]
    files = spark.createDataFrame(
        [("r", f"m{i}/package.json", t) for i, t in enumerate(texts)], "repo string, path string, content string"
    )
    rows = manifests.manifest_entries(files).collect()
    assert {(r.file, r.package, r.version, r.dependency_section) for r in rows if r.reason is None} == {
        ("m0/package.json", "a", "1.2.3", "dependencies"), ("m0/package.json", "b", "None", "dependencies"),
        ("m0/package.json", "c", "1.0", "devDependencies"),
    }
    assert {(r.file, r.raw) for r in rows if r.reason} == {("m0/package.json", "a2: latest"), ("m1/package.json", "")}


def _advisory(**fields):
    return json.dumps({"id": "A", **fields})


def test_advisories(spark, tmp_path):
    texts = [
        _advisory(id="1", affected=[{"ecosystem_specific": {"severity": " "}}, {"ecosystem_specific": {"severity": "high "}}]),
        _advisory(id="2", database_specific={"severity": "moderate"}, severity=[{"type": "t", "score": "LOW"}]),
        _advisory(id="3", severity=[{"type": "t", "score": "7.1"}, {"type": "t", "score": "x:low critical"}]),
        _advisory(id="4", affected=[{"package": {"name": "p", "ecosystem": "npm"}, "versions": ["1", "2"], "ranges": [
            {"events": [{"introduced": "0"}, {"fixed": " 2 "}, {"fixed": "2"}]}, {"events": [{"fixed": v} for v in "34567"]}]}]),
    ]
    (tmp_path / "a.json").write_text("\n".join(texts))
    bodies = advisory_source.read_advisories(spark, str(tmp_path))
    got = {r.id: r for r in dependencies.advisory_facts(bodies).collect()}
    assert [got[k].severity_label for k in "1234"] == ["HIGH", "MODERATE", "CRITICAL", "UNKNOWN"]
    assert got["4"].fixed_versions == ["2", "3", "4", "5", "6"] and got["1"].fixed_versions == []
    refs = {(r.package, r.version, r.id) for r in advisory_source.advisory_refs(bodies).collect()}
    assert refs == {("p", "1", "4"), ("p", "2", "4")}


def test_repo_urls(spark):
    cases = {
        "https://github.com/o/p": ("o", "p"), "https://www.github.com/o/p.git/tree": ("o", "p"),
        "//github.com/o/p": ("o", "p"), "https://github.com/o/p;x?q#f": ("o", "p"), "https://github.com/o": None,
        "https://GitHub.com/o/p": None, "https://u@github.com/o/p": None, "github.com/o/p": None, "": None,
        "https://github.com:443/o/p": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "u string")
    for r in rows.select("u", repo_of_url(F.col("u")).alias("r")).collect():
        assert (r.r and (r.r.owner, r.r.repo)) == cases[r.u], r.u


def test_repo_damping(spark):
    rows = spark.createDataFrame([(p,) for p in (10.0, 20.0, 34.99, 35.0, 42.0)], "p double")
    points = repo.repo_points(F.lit(0).cast("bigint"), F.lit(0), F.col("p"))
    got = [(round(r.x, 2), r.risk) for r in rows.select(points.alias("x"), risk_level(points).alias("risk")).collect()]
    assert got == [(10.0, "yellow"), (18.0, "yellow"), (31.49, "yellow"), (29.75, "yellow"), (35.7, "red")]


def test_rollup_ignores_other_repositories(spark):
    rows = [("a", i, "red" if i == 3 else "green", 10.0 * i, f"src/{i}.py", ["files"], ["Reads or writes local files."])
            for i in range(4)]
    schema = "repo string, file_ord int, risk string, risk_points double, path string, touches array<string>, behavior_summary array<string>"
    one = repo.rollup_files(spark.createDataFrame(rows, schema)).collect()
    more = rows + [("b", 0, "limit", 100.0, "x.yml", [], [])]
    two = {r.repo: r for r in repo.rollup_files(spark.createDataFrame(more, schema)).collect()}
    assert two["a"] == one[0] and one[0].highest_file_risk == "red" and one[0].weighted_points == 600_000
    assert two["b"].weighted_points == 400_000 and two["b"].highest_file_risk == "green"


def test_ranked_within_equals_row_number(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.randrange(4), rng.randrange(3), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, y int, i int")
    got = {r.i: r.rank for r in ranking.ranked_within(df, ["g"], ["x", "y"], ["i"], "rank").collect()}
    for g in "ab":
        for place, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1):
            assert got[r[3]] == place


@pytest.mark.parametrize("earlier", [False, True])
def test_quota_with_plan_changes(spark, earlier):
    """One request at a time, with plans that change during the day, against the table plan."""
    plans = {"free": PlanLimits(None, None, None, 3), "pro": PlanLimits(None, None, None, 7), "admin": PlanLimits(None, None, None, None)}
    rng = random.Random(2)
    day = dt.datetime(2024, 1, 1)
    rows = [
        (i, f"u{rng.randrange(6)}", day + dt.timedelta(days=rng.randrange(2), minutes=rng.randrange(500)),
         rng.choice(["free", "free", "pro", "admin"])) for i in range(400)
    ]
    used = {("u1", day.date()): 2, ("u2", day.date()): 9} if earlier else {}
    expected, counts = {}, dict(used)
    for i, actor, ts, plan in sorted(rows, key=lambda r: (r[2], r[0])):
        cap, key = plans[plan].daily_scan_limit, (actor, ts.date())
        expected[i] = cap is None or counts.get(key, 0) < cap
        if cap is not None and expected[i]:
            counts[key] = counts.get(key, 0) + 1
    requests = spark.createDataFrame(rows, "scan_id int, actor_key string, ts timestamp, plan string").withColumn(
        "usage_date", F.to_date("ts"))
    usage = spark.createDataFrame(
        [(a, d, "free", n) for (a, d), n in used.items()], "actor_key string, usage_date date, plan string, scan_count bigint"
    ) if earlier else None
    admitted = quota.admit(requests, usage, plans)
    assert {r.scan_id: r.admitted for r in admitted.collect()} == expected
    merged = quota.daily_usage(admitted)
    if earlier:
        merged = quota.upsert_usage(usage, merged)
    assert {(r.actor_key, r.usage_date): r.scan_count for r in merged.collect()} == counts


def test_quota_cuts_groups_before_the_shuffle(spark, small):
    plan = quota.admit(fixtures.derive(spark, small, fixtures.SCAN_REQUESTS))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_skipped_top_is_cut_before_the_shuffle(spark, small):
    entries = manifests.requirement_entries(fixtures.derive(spark, small, fixtures.MANIFEST_LINES))
    assert "WindowGroupLimit" in manifests.skipped_top(entries)._jdf.queryExecution().executedPlan().toString()


def test_repo_limits_do_not_read_contents(spark, small, tmp_path):
    fixtures.code_files(spark, small).withColumn("size_bytes", F.octet_length("content").cast("bigint")).write.parquet(
        str(tmp_path / "files"))
    files = file_source.read_file_table(spark, str(tmp_path / "files"))
    plan = limits.repo_limits(files, fixtures.derive(spark, small, fixtures.REPO_REQUESTS))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "content" not in text and "BroadcastHashJoin" in text


def test_file_tree(spark, tmp_path):
    (tmp_path / "r1" / "src").mkdir(parents=True)
    (tmp_path / "r1" / "src" / "a.py").write_bytes(b"x\xff\xfe = 1\n\xe2\x82")
    (tmp_path / "r1" / "b.md").write_text("é")
    got = {r.path: (r.repo, r.content, r.size_bytes) for r in file_source.read_file_tree(spark, str(tmp_path)).collect()}
    assert got == {"r1/src/a.py": ("r1", "x = 1\n", 10), "r1/b.md": ("r1", "é", 2)}


def test_stream_scan_equals_batch(spark, small, tmp_path):
    files = fixtures.code_files(spark, small)
    files.write.parquet(str(tmp_path / "in"))
    arriving = jobs.stream_table(spark, str(tmp_path / "in"), files)
    jobs.start_scan(file_reports(arriving), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    show = lambda df: sorted((r.file_id, r.risk_points, r.summary) for r in df.select("file_id", "risk_points", "summary").collect())
    assert show(spark.read.parquet(str(tmp_path / "out"))) == show(file_reports(files))


def test_usage_batches_are_idempotent(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    make = lambda rows: spark.createDataFrame(rows, "actor_key string, usage_date date, scan_count bigint")
    path = str(tmp_path / "usage")
    sinks.write_usage_batch(make([("a", day, 1), ("b", day, 2)]), path, 0)
    sinks.write_usage_batch(make([("a", day, 4)]), path, 1)
    sinks.write_usage_batch(make([("a", day, 4)]), path, 1)
    assert {r.actor_key: r.scan_count for r in sinks.read_usage(spark, path).collect()} == {"a": 4, "b": 2}


def test_report_sink(spark, small, tmp_path):
    reports = file_reports(fixtures.code_files(spark, small), call_sites=False)
    sinks.write_reports(reports, str(tmp_path), ["file_id"])
    findings = sinks.read_findings(spark, str(tmp_path))
    assert findings.count() == sum(len(r.findings) for r in reports.select("findings").collect())
    assert findings.where(F.col("explanation").isNull() | F.col("suggested_fix").isNull()).count() == 0


def test_reports_are_keyed_by_request(spark):
    files = spark.createDataFrame(
        [("r1", "a.py", 1, 40, "import os\nx = input()\nos.system(x)\n"), ("r1", "b.md", 2, 2, "b")],
        "repo string, path string, file_ord long, size_bytes long, content string",
    )
    requests = spark.createDataFrame(
        [("q1", "r1", "o/r1", "draw a simple monthly chart", "free"), ("q2", "r1", "o/r1", None, "PRO"),
         ("q3", "r1", "o/r1", None, "pro"), ("q4", "none", "o/none", "scan", None)],
        "request_id string, repo string, repo_name string, intent string, plan string",
    )
    entries = manifests.requirement_entries(
        spark.createDataFrame([], "repo string, file string, line int, raw string"))
    names = spark.createDataFrame([], "repo string, file string")
    bodies = advisory_source.nest_advisories(spark.createDataFrame(
        [], "ecosystem string, package string, version string, id string, severity string, summary string, fixed string"))
    got = {r.request_id: r for r in repo_scan.repo_reports(
        files, requests, advisory_source.advisory_refs(bodies), bodies, entries=entries, manifest_names=names).collect()}
    assert sorted(got) == ["q1", "q2", "q3", "q4"]
    assert [got[q].files_scanned_count for q in sorted(got)] == [1, 1, 1, 0]
    assert [got[q].plan for q in sorted(got)] == ["free", "pro", "pro", "free"]
    assert [got[q].repo_size_bytes for q in sorted(got)] == [40, 40, 40, 0]
    assert got["q1"].risk_points > 0 and got["q2"].risk_points == got["q3"].risk_points > 0
    assert got["q4"].risk == "green" and got["q4"].risk_points == 0 and got["q4"].admitted


def test_long_values_are_kept_whole(spark):
    long = "1." + "2" * 1_100_000
    row = spark.createDataFrame([(f"^{long}", "p" * 2_000)], "v string, plan string")
    assert row.select(normalize_version(F.col("v"))["version"]).first()[0] == long
    assert len(row.select(limits._capitalized(F.col("plan"))).first()[0]) == 2_000


def test_only_bad_bytes_are_dropped(spark):
    rng = random.Random(8)
    parts = [b"a", b"\xff", b"\xef\xbf\xbd", "é".encode(), "😀".encode(), b"\xf0\x9f", b"\xe2\x82", b"\xc0\x80", b"\xed\xa0\x80", b"\x80", b"\n"]
    texts = [b"".join(rng.choices(parts, k=12)) for _ in range(200)] + [b"", b"\xff" * 20_000 + b"x"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, b binary").select("i", file_source.decode_ignoring(F.col("b")).alias("t")).collect()
    assert all(r.t == texts[r.i].decode("utf-8", "ignore") for r in got)


def test_file_tree_root_is_cut_once(spark, tmp_path):
    inner = tmp_path / "r1" / str(tmp_path).strip("/") / "x"
    inner.mkdir(parents=True)
    (inner / "a.py").write_text("x")
    rows = file_source.read_file_tree(spark, str(tmp_path)).collect()
    assert [r.repo for r in rows] == ["r1"] and rows[0].path.endswith("/x/a.py")
    assert rows[0].file_ord == file_source.read_file_tree(spark, str(tmp_path)).first().file_ord
