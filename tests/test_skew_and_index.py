"""Many rules by an index, heavy hitters by salts, file tables in buckets."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.operators import dependencies, rule_index
from riskframe.rules import BehaviorRule
from riskframe.sources import files as file_source


def _lines(seed, n=400):
    rng = random.Random(seed)
    names = [w for r in rules.BEHAVIOR_RULES for w in re.findall(r"\w+", r.key)] + ["curl", "wget", "x", "my", "_", "é"]
    glue = [".", "(", " (", " ", "", "  ", "é", ";", "_"]
    return [(i, "".join(rng.choice(names) + rng.choice(glue) for _ in range(rng.randrange(9)))) for i in range(n)]


EXTRA = [
    BehaviorRule("either", r"\bfoo\b|\bcurl\b", 1), BehaviorRule("maybe", r"\bwget\s?x?", 2), BehaviorRule("class", r"[xy]my", 3),
    BehaviorRule("two", r"\b(curl|wget)\s*\(", 4), BehaviorRule("tail", r"\bopen", 5),
]


def test_index_finds_what_each_rule_finds(spark):
    rows, every = _lines(1), [*rules.BEHAVIOR_RULES, *EXTRA]
    lines = spark.createDataFrame(rows, "i int, code string")
    got = sorted((r["i"], r["seq"]) for r in rule_index.rule_hits(lines, every, "t").collect())
    assert got == sorted((i, seq) for i, code in rows for seq, r in enumerate(every) if re.search(r.pattern, code)) and got


def test_keywords():
    cases = {
        r"\bos\.system\s*\(": ["system"], r"(?<![\w.])eval\s*\(": ["eval"], r"\b(curl|wget)\b": ["curl", "wget"], r"\ba\b|\bb\b": [], r"open\s*\(": [],
        r"\bfoo": [], r"\bfoo\b(?:bar)?": [], r"\bfoo[a-z]": [], r"\bFoo\.bar2\b": ["bar2"],
    }
    assert {p: rule_index.keywords(p) for p in cases} == cases


def test_cost_does_not_follow_the_number_of_rules(spark):
    rows = spark.range(200_000).select("id", F.concat(F.lit("call"), F.col("id") % 5_000, F.lit(" (a, b); name"), F.col("id") % 7).alias("code")).repartition(8).cache()
    rows.count()

    def seconds(n):
        made = [BehaviorRule(f"r{i}", rf"\bcall{i}\s*\(", 1) for i in range(n)]
        start = time.perf_counter()
        assert rule_index.rule_hits(rows, made, "t").count() == n * 40
        return time.perf_counter() - start

    seconds(25)
    few = min(seconds(25) for _ in range(3))
    assert min(seconds(1_000) for _ in range(3)) < 2 * few + 1.5
    rows.unpersist()


@pytest.mark.parametrize("share", [2, 10, 1_000])
def test_salted_refs(spark, share):
    rng = random.Random(share)
    rows = [("PyPI", rng.choice(["hot"] * 8 + [f"p{i}" for i in range(20)]), "1", "r", i) for i in range(2_000)]
    deps = spark.createDataFrame(rows, "ecosystem string, package string, version string, repo string, line int")
    refs = spark.createDataFrame([("PyPI", p, "1", f"{p}-{k}") for p in ("hot", "p1", "p2", "unseen") for k in range(3)], "ecosystem string, package string, version string, id string")
    plain = sorted(tuple(r) for r in dependencies.dependency_refs(deps, refs).collect())
    assert sorted(tuple(r) for r in dependencies.salted_refs(deps, refs, share).collect()) == plain
    assert dependencies.frequent_versions(deps, share).count() < share
    assert dependencies.salted_refs(deps.limit(0), refs, share).count() == 0


def test_salted_refs_deal_out_a_hot_package(spark):
    """Half of all rows on one package: no task of the join has more than twice the median."""
    deps = spark.range(40_000).select(
        F.lit("PyPI").alias("ecosystem"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("package"),
        F.lit("1").alias("version"), F.col("id").alias("line"),
    )
    refs = deps.select("ecosystem", "package", "version").distinct().withColumn("id", F.lit("A"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = dependencies.salted_refs(deps, refs, salts=512).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    counts = sorted(r["count"] for r in rows)
    assert sum(counts) == 40_000 and counts[-1] <= 2 * counts[len(counts) // 2]


def test_bucketed_files_join_without_moving_contents(spark):
    files = spark.range(500).select(F.concat(F.lit("r"), F.col("id") % 20).alias("repo"), F.col("id").cast("string").alias("path"), F.repeat(F.lit("x"), 100).alias("content"))
    file_source.write_file_table(files, "bucketed_files_test", 8)
    verdicts = spark.range(20).select(F.concat(F.lit("r"), "id").alias("repo"), (F.col("id") % 2 == 0).alias("admitted"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_files_test").join(verdicts.where("admitted"), "repo")
        assert joined.count() == 250
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_files_test")
    sides = plan.split("SortMergeJoin", 1)[1]
    above, scan = sides[: sides.index("FileScan")], sides[sides.index("FileScan") :].splitlines()[0]
    assert "Exchange" not in above and "content" in scan and "Bucketed: true" in scan


def test_a_list_of_rules_is_met_without_a_shuffle_of_the_lines(spark):
    """Each word of a line used to be a shuffled row that held the whole line."""
    lines = spark.range(10).select(F.col("id").alias("i"), F.lit("x = eval(y) + eval (z)").alias("t"))
    for made in ([rules.BEHAVIOR_RULES[0]] * 2, rules.BEHAVIOR_RULES):
        plan = rule_index.rule_hits(lines, made, "t", "t")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def _hot_package(spark):
    """Dependencies of two repositories on one package version that very many advisories name."""
    from riskframe.sources import advisories

    flat = spark.range(200).select(F.lit("npm").alias("ecosystem"), F.lit("p").alias("package"), F.lit("1").alias("version"), F.concat(F.lit("A"), F.col("id") % 150).alias("id"),
                                   F.element_at(F.array(*map(F.lit, ["LOW", "high", "CRITICAL", ""])), (F.col("id") % 4 + 1).cast("int")).alias("severity"), F.lit("s").alias("summary"), F.lit("2").alias("fixed"))
    bodies = advisories.nest_advisories(flat)
    deps = spark.range(60).select(
        F.concat(F.lit("r"), F.col("id") % 2).alias("repo"), F.concat(F.lit("top/"), F.when(F.col("id") % 3 == 0, "tests/").otherwise(""), "id", F.lit("/package.json")).alias("file"),
        F.lit("package.json").alias("manifest_type"), F.lit(1).alias("line"), F.lit("npm").alias("ecosystem"), F.lit("p").alias("package"), F.lit("1").alias("version"),
        F.lit("1").alias("declared_version"), F.lit("exact").alias("version_kind"), F.lit("dependencies").alias("dependency_section"),
    )
    return deps, advisories.advisory_refs(bodies), bodies


def test_totals_are_those_of_the_findings(spark):
    deps, refs, bodies = _hot_package(spark)
    found = dependencies.dependency_findings(deps, refs, bodies)
    totals = dependencies.finding_totals(deps, refs, bodies)
    names = ["repo", "advisory_count", "unique_package_versions", "unique_manifest_files", "unique_vulnerability_ids"]
    rows = lambda df, *columns: sorted(tuple(r) for r in df.select(*columns).collect())
    assert rows(totals, *names) == rows(dependencies.rollup(found), *names)
    points = dependencies.capped_points(F.col("cents")).alias("dependency_risk_points")
    assert rows(totals, "repo", points) == rows(dependencies.dependency_points(found), "repo", "dependency_risk_points")


def test_findings_are_made_by_the_last_join(spark):
    """Pairs of dependencies and advisories are no side of another join."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = dependencies.dependency_findings(*_hot_package(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in plan.splitlines() if "Join" in line or "CartesianProduct" in line]
    assert len(joins) == 2 and "[id#" not in joins[0] and "[id#" in joins[1]


def test_tiles_make_every_pair_once(spark):
    """Lists of any size give the pairs of the plain join; null keys meet nothing, and rows that come twice stay two."""
    keys = "ecosystem string, package string, version string"
    deps = [("npm", "p", "1", f"f{i % 9}") for i in range(23)] + [("npm", None, "1", "n"), ("npm", "q", "2", None), ("npm", "alone", "1", "a")]
    refs = [("npm", "p", "1", f"A{i}") for i in range(11)] + [("npm", None, "1", "N"), ("npm", "q", "2", "Q"), ("npm", "q", "2", "Q"), ("PyPI", "p", "1", "P")]
    left, right = spark.createDataFrame(deps, f"{keys}, file string"), spark.createDataFrame(refs, f"{keys}, id string")
    rows = lambda df: sorted(map(str, df.collect()))
    plain = rows(dependencies.dependency_refs(left, right))
    assert len(plain) == 23 * 11 + 2
    for tile in (1, 4, 1_000):
        assert rows(dependencies.dependency_refs(left, right, tile)) == plain


def test_findings_of_one_package_version_are_made_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(dependencies, "TILE", 10, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = dependencies.dependency_findings(*_hot_package(spark))
        made = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(made) == 60 * 200 and len(made) > 4 and max(made) < 60 * 200 / 2


def test_what_follows_from_one_side_is_not_worked_out_for_each_pair(spark):
    """Path weights and lists of an advisory are made below the pairs."""
    found = dependencies.dependency_findings(*_hot_package(spark), joined="|").select("aliases", "fixed_versions", "severity", "explanation")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Generate")
    assert not [f for f in ("RLIKE", "array_join", "format_string", "element_at") if f in above]
    assert all(f in below for f in ("RLIKE", "array_join", "format_string", "element_at"))


def test_lists_and_explanations_of_findings(spark):
    deps, refs, bodies = _hot_package(spark)
    plain = dependencies.dependency_findings(deps, refs, bodies, max_explanation=None)
    note = dependencies.texts.ADVISORY_WEIGHT_NOTE % "0.35"
    assert {(r.path_weight, r.explanation) for r in plain.collect()} == {(1.0, "s"), (0.35, "s" + note)}
    key = ["file", "id", "severity", "aliases", "fixed_versions", "explanation"]
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.select(*key).collect())
    cut = dependencies.dependency_findings(deps, refs, bodies, max_explanation=20, joined="|")
    lists = {c: F.array_join(c, "|") for c in ("aliases", "fixed_versions")}
    assert rows(cut) == rows(plain.withColumns({**lists, "explanation": F.substring("explanation", 1, 20)}))
