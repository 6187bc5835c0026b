"""Named queries over a directory of driver tables: ``(spark, sf_dir) -> DataFrame``.

Results are flat (arrays joined or exploded), so they can be compared value by value.  Helpers
default to ``call_sites=False``; queries that need the Arrow step ask for it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.functions import paths, scores
from riskframe.functions.columns import rows_of
from riskframe.functions.versions import normalize_version
from riskframe.operators import (
    callsites, dependencies, detect, findings, focus, heuristics, intent, limits, lines, manifests, parts,
    quota, repo, rule_index, taint,
)
from riskframe.plans import file_scan, repo_scan
from riskframe.plans.manifest_scan import repo_dependencies
from riskframe.rules import BehaviorRule, PlanLimits, SecretRule
from riskframe.sources import advisories as advisory_source
from riskframe.sources import files as file_source
from riskframe.sources import fixtures, sinks
from riskframe.sources.shared import shared_folder
from riskframe.streaming import jobs
from riskframe.streaming import quota as stream_quotas

JOIN = "|"

# Limits small enough to bind on the test tables.
TIGHT_LIMITS = {
    "free": PlanLimits(3, 20, 1_500, 5),
    "pro": PlanLimits(4, 36, 2_000_000, 50),
    "admin": PlanLimits(None, None, None, None),
}

# Corpus rules that hit the natural tables.
CORPUS_SECRET_RULES = [
    SecretRule(r'token = "[0-9a-f]{40}"', "Possible access token", 30),
    SecretRule(r"[A-Za-z0-9._]+@[A-Za-z0-9.\-]+\.[a-z]{2,}", "Possible e-mail address", 5),
    SecretRule(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "Possible network address", 2),
]
CORPUS_BEHAVIOR_RULES = [
    BehaviorRule("license", r"\b(licen[sc]e|copyright)\b", 1, label="License or copyright line"),
    BehaviorRule("track(", r"\btrack\s*\(", 3, "track", label="Tracking call"),
]


def _joined(array: Column | str) -> Column:
    return F.array_join(array, JOIN)


def _files(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.code_texts(spark, d)


def _id_text(files: DataFrame) -> DataFrame:
    return files.select("file_id", "content")


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    return lines.with_scannable(_id_text(_files(spark, d)))


def _found(spark: SparkSession, d: str, call_sites: bool = False) -> DataFrame:
    return file_scan.with_findings(_files(spark, d), call_sites=call_sites)


def _reports(spark: SparkSession, d: str, call_sites: bool = False) -> DataFrame:
    return file_scan.file_reports(_files(spark, d), call_sites=call_sites)


def _code_reports(spark: SparkSession, d: str, call_sites: bool = False) -> DataFrame:
    return file_scan.file_reports(file_source.code_files(_files(spark, d)), call_sites=call_sites)


# --- sources and lines -----------------------------------------------------------------------------


def scan_files(spark, d):
    return _files(spark, d).select(
        "file_id", "repo", "file_ord", "path", F.octet_length("content").cast("bigint").alias("size_bytes")
    )


def code_file_filter(spark, d):
    return file_source.code_files(_files(spark, d)).select("file_id", "path")


def manifest_filter(spark, d):
    names = (
        _files(spark, d).select("path")
        .unionByName(fixtures.derive(spark, d, fixtures.PACKAGE_JSON).select("path"))
        .unionByName(fixtures.derive(spark, d, fixtures.MANIFEST_LINES).select(
            F.concat("repo", F.lit("/"), "file").alias("path")).distinct())
    )
    return file_source.manifest_files(names).select(
        "path", "ecosystem", paths.is_code_file(F.col("path")).alias("is_code")
    )


def line_explode(spark, d):
    texts = fixtures.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return lines.line_explode(texts)


def _wrapped(spark, d):
    """The code files with marker blocks wrapped around their text."""
    return _files(spark, d).select("file_id", F.concat(
        F.lit("SECRET_PATTERNS = [\n  inner\n]\nkept\nfunction loadSafeExample() {\n  if (a) {\n  }\n}\n"),
        F.col("content"),
        F.lit("\nexplanations = {\n  a: 1,\n}\nlast"),
    ).alias("content"))


def exclude_blocks(spark, d):
    return lines.scannable_lines(_wrapped(spark, d)).select("file_id", "line_no", "line")


#: Characters of a part, so small that lines and line breaks cross parts.
PART_SIZE = 700


def _part_lines(spark, d):
    return parts.line_rows(parts.cut(_id_text(_files(spark, d)), PART_SIZE))


def part_lines(spark, d):
    """Lines of the documents, stored in parts."""
    texts = fixtures.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))
    return parts.line_rows(parts.cut(texts, PART_SIZE)).withColumnRenamed("file_id", "doc_id")


def part_exclude_blocks(spark, d):
    """The lines that count of the code files with marker blocks around them, stored in parts."""
    return parts.scannable_rows(parts.line_rows(parts.cut(_wrapped(spark, d), PART_SIZE)))


def part_functions(spark, d):
    """The function around every line that counts, of files stored in parts."""
    return parts.function_rows(parts.scannable_rows(_part_lines(spark, d)))


def strip_literals(spark, d):
    return lines.strip_literals_per_line(_id_text(fixtures.code_texts(spark, d)))


# --- detection ---------------------------------------------------------------------------------------


def _line_findings(spark, d, behavior=tuple(rules.BEHAVIOR_RULES), secrets=tuple(rules.SECRET_RULES)):
    found = file_scan.with_findings(
        _files(spark, d), behavior=behavior, secrets=secrets, call_sites=False, heuristic=False
    )
    return findings.finding_rows(found, "all_findings").select(
        "file_id", "line", "pattern", "severity", "type", "message", "note"
    )


def behavior_findings(spark, d):
    return _line_findings(spark, d, secrets=())


def secret_findings(spark, d):
    return _line_findings(spark, d, behavior=()).drop("note")


def taint_sources(spark, d):
    return taint.taint_sources(_id_text(_files(spark, d)))


def assigned_vars(spark, d):
    return taint.assigned_variables(_id_text(_files(spark, d))).drop("line")


def taint_map(spark, d):
    return taint.taint_map(_id_text(_files(spark, d)))


def call_arguments(spark, d):
    return detect.call_argument_rows(lines.line_explode(_id_text(_files(spark, d))))


def literal_arguments(spark, d):
    return call_arguments(spark, d).withColumn("is_literal", detect.is_literal_argument(F.col("args")))


def trusted_network_lines(spark, d):
    pages = fixtures.table(spark, d, "pages").select("page_id", F.concat(
        "url", F.when(F.col("page_id") % 4 == 0, "\nuse API.OSV.dev\ncall certifi.where()").otherwise("\nplain")
    ).alias("content"))
    return lines.line_explode(pages).withColumn(
        "is_trusted", detect.is_trusted_network_line(F.col("line"))
    ).drop("line")


def enclosing_function(spark, d):
    return detect.enclosing_function_rows(_scanned(spark, d))


def sink_boost(spark, d):
    return detect.sink_rows(_scanned(spark, d)).select("file_id", "line", "pattern", "boost", "note")


def tainted_sinks(spark, d):
    return detect.sink_rows(_scanned(spark, d)).where(F.col("variable").isNotNull()).select(
        "file_id", "line", "pattern", "variable"
    )


def file_heuristics(spark, d):
    found = heuristics.heuristic_findings(F.col("scan_text"), F.col("text_code"), F.col("runs"))
    return _scanned(spark, d).select("file_id", F.explode(found).alias("f")).select(
        "file_id", "f.line", "f.pattern", "f.severity", "f.message"
    )


def ast_call_sites(spark, d):
    return callsites.call_site_rows(_id_text(_files(spark, d)))


def ast_findings(spark, d):
    return callsites.call_finding_rows(_id_text(_files(spark, d))).select(
        "file_id", "line", "pattern", "severity", "seq", "note"
    )


def indexed_word_rules(spark, d):
    """Lines of the documents that name a longer word of the benchmark: a rule for each, met through an index."""
    words = fixtures.table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    rules_of = rule_index.word_rules(words.where(F.length("word") >= 9).distinct(), "benchmark word")
    texts = fixtures.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return rule_index.indexed_hits(lines.line_explode(texts).withColumn("line", F.lower("line")), rules_of, "line").select("doc_id", F.col("line_no").alias("line"), "pattern", "message", "points")


def indexed_behavior(spark, d):
    """The behaviour rules on lines without literals, met through an index."""
    code = parts.code_rows(lines.line_explode(_id_text(_files(spark, d)))).drop("line")
    return rule_index.rule_hits(code, rules.BEHAVIOR_RULES, "suspicious_behavior").select(
        "file_id", F.col("line_no").alias("line"), "seq", "pattern", "message", "points"
    )


def bucketed_repo_files(spark, d):
    """Code files and bytes of every request, with the files of its repository read from a table in buckets by repository."""
    name = f"files_{uuid.uuid4().hex}"
    # A bucket is one task's to read, so the sizes stand beside the contents: a request for them reads no contents.
    size = F.octet_length("content").cast("bigint").alias("size_bytes")
    file_source.write_file_table(_files(spark, d).select("repo", "path", size, "content"), name, 8)
    asked = fixtures.derive(spark, d, fixtures.REPO_REQUESTS).select("request_id", "repo")
    rows = spark.table(name).join(asked, "repo").groupBy("request_id", "repo")
    return rows.agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("bytes"))


def program_call_sites(spark, d):
    """Calls of every watched target in programs that hold the documents' whole texts."""
    return callsites.call_site_rows(fixtures.derive(spark, d, fixtures.PROGRAMS))


def corpus_secret_scan(spark, d):
    texts = fixtures.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    found = file_scan.with_findings(
        texts, behavior=CORPUS_BEHAVIOR_RULES, secrets=CORPUS_SECRET_RULES, call_sites=False, heuristic=False
    )
    return findings.finding_rows(found, "all_findings", ["doc_id"]).select(
        "doc_id", "line", "pattern", "severity", "type", "message"
    )


def corpus_script_scan(spark, d):
    texts = fixtures.table(spark, d, "pages").select("page_id", F.col("html").alias("content"))
    found = file_scan.with_findings(
        texts, behavior=CORPUS_BEHAVIOR_RULES, secrets=CORPUS_SECRET_RULES, call_sites=False, heuristic=False
    )
    return findings.finding_rows(found, "all_findings", ["page_id"]).select(
        "page_id", "line", "pattern", "severity", "type", "message"
    )


def corpus_focus_windows(spark, d):
    texts = fixtures.table(spark, d, "documents").select(
        "doc_id", F.lit("scan this").alias("intent"), F.col("text").alias("content")
    )
    reports = file_scan.file_reports(
        texts, behavior=CORPUS_BEHAVIOR_RULES, secrets=CORPUS_SECRET_RULES, call_sites=False
    )
    return reports.select("doc_id", F.explode(rows_of("focused_code_blocks")).alias("b")).select(
        "doc_id", "b.start_line", "b.end_line"
    )


# --- findings and file verdicts --------------------------------------------------------------------

_FINDING = ["file_id", "line", "pattern", "severity", "src_rank", "type"]


def all_findings(spark, d):
    return findings.finding_rows(_found(spark, d, call_sites=True), "all_findings").select(*_FINDING)


def dedupe_findings(spark, d):
    return findings.finding_rows(_reports(spark, d, call_sites=True)).select(*_FINDING)


def finding_explanations(spark, d):
    rows = findings.finding_rows(_reports(spark, d, call_sites=True))
    return findings.explain_findings(rows).select(
        "file_id", "line", "pattern", "explanation", *findings.GUIDANCE_FIELDS
    )


def file_touches(spark, d):
    return _reports(spark, d).select("file_id", _joined("touches").alias("touches"))


def file_risk_points(spark, d):
    return _reports(spark, d, call_sites=True).select(
        "file_id", F.aggregate("findings", F.lit(0.0), lambda s, f: s + f["severity"]).alias("finding_points"),
        "risk_points",
    )


def trust_score(spark, d):
    return _reports(spark, d, call_sites=True).select(
        "file_id", "risk", "trust_score", F.col("trust_badge.label").alias("label"),
        F.col("trust_badge.color").alias("color"), F.col("trust_badge.message").alias("message"),
    )


def intent_quality(spark, d):
    return _files(spark, d).select(
        "file_id", "intent", intent.is_meaningful(F.col("intent")).alias("is_meaningful")
    )


def intent_mismatch(spark, d):
    return _reports(spark, d).select("file_id", F.posexplode(rows_of("intent_mismatches")).alias("pos", "message"))


def behavior_summary(spark, d):
    return _reports(spark, d).select("file_id", F.posexplode(rows_of("behavior_summary")).alias("pos", "sentence"))


def focus_windows(spark, d):
    return _reports(spark, d).select("file_id", F.explode(rows_of("focused_code_blocks")).alias("b")).select(
        "file_id", "b.start_line", "b.end_line"
    )


def focus_blocks(spark, d):
    blocks = _reports(spark, d).select("file_id", F.explode(rows_of("focused_code_blocks")).alias("b"))
    return blocks.select("file_id", "b.start_line", F.explode(rows_of("b.lines")).alias("l")).select(
        "file_id", "start_line", "l.line", "l.content", "l.flagged"
    )


def _flat_report(reports: DataFrame) -> DataFrame:
    return reports.select(
        "file_id", "path", "risk", "risk_points", "trust_score", _joined("touches").alias("touches"),
        _joined("intent_mismatches").alias("intent_mismatches"),
        _joined("behavior_summary").alias("behavior_summary"), "summary",
        F.size("findings").alias("finding_count"),
        F.coalesce(F.size("focused_code_blocks"), F.lit(0)).alias("block_count"),
    )


def file_report(spark, d):
    return _flat_report(_reports(spark, d, call_sites=True))


def corpus_file_report(spark, d):
    """The whole report over the code files with their full document text."""
    return _flat_report(file_scan.file_reports(fixtures.code_texts(spark, d)))


def ranked_files(spark, d):
    """Flagship: code files by risk, with score and badge."""
    # Dealt out first: a sort reads its input twice, once for the bounds of its ranges, and would scan all files twice.
    return _flat_report(_code_reports(spark, d, call_sites=True)).repartition("file_id").orderBy(
        F.desc("risk_points"), "file_id"
    )


# --- limits, quota, actors ---------------------------------------------------------------------------


def _planned_files(spark, d):
    plans = fixtures.derive(spark, d, fixtures.REPO_REQUESTS)
    return _files(spark, d).join(plans.select("repo", "plan"), "repo")


def line_limit(spark, d):
    return file_scan.file_reports(
        _planned_files(spark, d), call_sites=False, plan_limits=TIGHT_LIMITS
    ).select("file_id", "plan_applied", "line_limit", "line_count", "risk", "risk_points", "trust_score", "summary")


def plan_limits(spark, d):
    requests = fixtures.derive(spark, d, fixtures.SCAN_REQUESTS).select(
        "scan_id", F.when(F.col("plan") == "pro", "PRO").when(F.col("scan_id") % 7 == 0, "enterprise")
        .otherwise(F.col("plan")).alias("plan")
    )
    return limits.with_plan_limits(requests)


def account_access(spark, d):
    accounts = fixtures.table(spark, d, "events").select(
        "event_id",
        F.when(F.col("user_id") % 4 == 0, "Admin").when(F.col("user_id") % 4 == 1, "").alias("role"),
        F.when(F.col("user_id") % 3 == 0, "Pro").when(F.col("user_id") % 3 == 1, "").alias("plan"),
    )
    access = limits.role_and_plan(F.col("role"), F.col("plan"))
    return accounts.select("event_id", access.alias("a")).select("event_id", "a.role", "a.plan")


def repo_limits(spark, d):
    meta = _files(spark, d).select(
        "repo", "path", F.octet_length("content").cast("bigint").alias("size_bytes")
    )
    return limits.repo_limits(meta, fixtures.derive(spark, d, fixtures.REPO_REQUESTS), TIGHT_LIMITS)


def quota_admission(spark, d):
    return quota.admit(fixtures.derive(spark, d, fixtures.SCAN_REQUESTS)).select(
        "scan_id", "actor_key", "plan", "admitted", "limit_title", "limit_summary"
    )


def _usage(admitted: DataFrame) -> DataFrame:
    return quota.daily_usage(admitted)


def daily_usage(spark, d):
    return _usage(quota.admit(fixtures.derive(spark, d, fixtures.SCAN_REQUESTS))).select(
        "actor_key", F.col("usage_date").cast("string").alias("usage_date"), "plan", "scan_count"
    )


def usage_upsert(spark, d):
    """Morning requests make the snapshot; the rest of the day is admitted on top of it and merged."""
    requests = fixtures.derive(spark, d, fixtures.SCAN_REQUESTS)
    morning = _usage(quota.admit(requests.where(F.hour("ts") < 12)))
    rest = _usage(quota.admit(requests.where(F.hour("ts") >= 12), morning))
    return quota.upsert_usage(morning, rest).select(
        "actor_key", F.col("usage_date").cast("string").alias("usage_date"), "plan", "scan_count"
    )


def actor_key(spark, d):
    events = fixtures.table(spark, d, "events")
    anonymous = F.col("event_type") == "error"
    return events.select("event_id", quota.actor_key(
        F.when(~anonymous, F.col("user_id")),
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 256), F.lit(" , 1.1.1.1"))),
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("host"), F.col("user_id"))),
        F.col("props"),
    ).alias("actor_key"))


# --- manifests and advisories ---------------------------------------------------------------------------


def _entries(spark, d):
    return manifests.requirement_entries(fixtures.derive(spark, d, fixtures.MANIFEST_LINES))


def parse_requirements(spark, d):
    return _entries(spark, d).select(
        "repo", "line", "package", "declared_version", "version", "version_kind", "raw", "reason"
    )


def normalize_versions(spark, d):
    raw = fixtures.derive(spark, d, fixtures.MANIFEST_LINES).select("repo", "line", F.regexp_replace(
        "raw", r"\A[a-z0-9\[\]]+", "").alias("raw_version"))
    return raw.select("repo", "line", "raw_version", normalize_version(F.col("raw_version")).alias("n")).select(
        "repo", "line", "raw_version", "n.version", "n.kind"
    )


def parse_package_json(spark, d):
    files = fixtures.derive(spark, d, fixtures.PACKAGE_JSON)
    return manifests.package_json_entries(files).select(
        "file_id", "package", "declared_version", "version", "version_kind", "dependency_section", "raw", "reason"
    )


def _dependencies(spark, d):
    return manifests.dedupe_dependencies(manifests.parsed(_entries(spark, d)))


def dedupe_dependencies(spark, d):
    return _dependencies(spark, d).select("repo", "line", "package", "version", "version_kind")


def deps_skipped_top(spark, d):
    return manifests.skipped_top(_entries(spark, d)).select("repo", "rank", "line", "raw", "reason")


def _snapshot(spark, d):
    bodies = advisory_source.nest_advisories(fixtures.derive(spark, d, fixtures.ADVISORIES))
    return advisory_source.advisory_refs(bodies), bodies


def _dependency_findings(spark, d):
    return dependencies.dependency_findings(_dependencies(spark, d), *_snapshot(spark, d))


def dep_advisory_refs(spark, d):
    refs, _ = _snapshot(spark, d)
    return dependencies.dependency_refs(_dependencies(spark, d), refs).select("repo", "line", "package", "version", "id")


def dep_findings(spark, d):
    return _dependency_findings(spark, d).select(
        "repo", "line", "package", "version", "version_kind", "id", _joined("aliases").alias("aliases"), "message",
        "severity_label", "severity", "base_severity", "path_weight", "explanation",
        _joined("fixed_versions").alias("fixed_versions"), "why_risky", "what_to_check",
    )


def dep_findings_ranked(spark, d):
    return dependencies.ranked_findings(_dependency_findings(spark, d)).select(
        "repo", "rank", "package", "version", "id", "severity"
    )


def salted_dep_refs(spark, d):
    """Every dependency with its advisories, where the dependencies of one package version are half of all rows."""
    half = F.when(F.col("line") % 2 == 0, F.struct(F.lit("pkg1").alias("package"), F.lit("1.2.1").alias("version")))
    named = _dependencies(spark, d).withColumn("p", F.coalesce(half, F.struct("package", "version")))
    skewed = named.withColumns({"package": F.col("p.package"), "version": F.col("p.version")}).drop("p")
    refs, _ = _snapshot(spark, d)
    return dependencies.salted_refs(skewed, refs).select("repo", "line", "package", "version", "id")


def advisory_severity(spark, d):
    _, bodies = _snapshot(spark, d)
    label = dependencies.severity_label(F.col("affected"), F.col("database_specific"), F.col("severity"))
    return bodies.select("id", label.alias("severity_label")).withColumn(
        "points", dependencies.severity_points(F.col("severity_label"))
    )


def fixed_versions(spark, d):
    _, bodies = _snapshot(spark, d)
    return bodies.select("id", F.posexplode(dependencies.fixed_versions(F.col("affected"))).alias("pos", "version"))


def _json_advisories(spark, d):
    return advisory_source.parse_advisory_lines(fixtures.derive(spark, d, fixtures.ADVISORY_JSON))


def _json_snapshot(spark, d):
    bodies = advisory_source.good_advisories(_json_advisories(spark, d)).drop("body", "line_no")
    return advisory_source.advisory_refs(bodies), bodies


def advisory_json(spark, d):
    """What a finding takes from advisories that are JSON lines of varying shape."""
    _, bodies = _json_snapshot(spark, d)
    facts = dependencies.advisory_facts(bodies)
    return facts.select(
        "id", "severity_label", dependencies.severity_points(F.col("severity_label")).alias("points"),
        _joined("fixed_versions").alias("fixed_versions"), _joined("aliases").alias("aliases"), "text", "published",
    )


def advisory_json_refs(spark, d):
    refs, _ = _json_snapshot(spark, d)
    return refs


def advisory_bad_lines(spark, d):
    return advisory_source.bad_lines(_json_advisories(spark, d))


def manifest_files_entries(spark, d):
    """Entries of manifest files of both kinds."""
    return manifests.manifest_entries(fixtures.manifest_files(spark, d)).select(
        "repo", "file", "ecosystem", "package", "declared_version", "version", "version_kind",
        F.coalesce("dependency_section", F.lit("")).alias("dependency_section"), "raw", "reason",
    )


def manifest_files_findings(spark, d):
    """Dependencies of both kinds of manifest files against the JSON advisories."""
    entries = manifests.manifest_entries(fixtures.manifest_files(spark, d))
    found = dependencies.dependency_findings(manifests.dedupe_dependencies(manifests.parsed(entries)), *_json_snapshot(spark, d), joined=JOIN)
    return found.select(
        "repo", "file", "ecosystem", "package", "version", "dependency_section", "id", "severity_label", "severity", "path_weight", "published",
        "fixed_versions", "aliases", "explanation",
    )


def dep_risk_points(spark, d):
    return dependencies.dependency_points(_dependency_findings(spark, d))


def dep_rollup(spark, d):
    return dependencies.rollup(_dependency_findings(spark, d))


def manifest_summary(spark, d):
    entries = _entries(spark, d)
    names = fixtures.derive(spark, d, fixtures.MANIFEST_LINES).select("repo", "file").distinct()
    return repo_dependencies(entries, names, *_snapshot(spark, d)).withColumn("summary_lines", _joined("summary_lines"))


# --- repositories ------------------------------------------------------------------------------------------


def path_weights(spark, d):
    return _files(spark, d).select(
        "path", (paths.code_percent(F.col("path")) / 100.0).alias("code_weight"),
        (paths.manifest_percent(F.col("path")) / 100.0).alias("manifest_weight"),
    )


def repo_url_parse(spark, d):
    requests = fixtures.derive(spark, d, fixtures.REPO_URLS)
    return repo_scan.parsed_requests(requests).select("page_id", "owner", "repo_short", "error")


def _rolled(spark, d):
    return repo.rollup_files(_code_reports(spark, d, call_sites=True))


def repo_risk(spark, d):
    totals = dependencies.finding_totals(_dependencies(spark, d), *_snapshot(spark, d))
    points = totals.select("repo", dependencies.capped_points(F.col("cents")).alias("dependency_risk_points"))
    rolled = _rolled(spark, d).join(points, "repo", "left").withColumn(
        "dependency_risk_points", F.coalesce("dependency_risk_points", F.lit(0.0))
    )
    return repo.with_repo_score(rolled).select(
        "repo", "files_scanned_count", "dependency_risk_points", "risk", "trust_score", "risk_points"
    )


def repo_highest_risk(spark, d):
    return _rolled(spark, d).select("repo", "highest_file_risk")


def repo_touches(spark, d):
    return _rolled(spark, d).select("repo", _joined("touches").alias("touches"))


def repo_behavior(spark, d):
    return _rolled(spark, d).select("repo", F.posexplode(rows_of("behavior_summary")).alias("pos", "sentence"))


def readme_badge(spark, d):
    rows = repo_risk(spark, d).select(
        "repo", scores.readme_badge(F.concat(F.lit("owner/"), "repo"), F.col("trust_score")).alias("b")
    )
    return rows.select("repo", "b.*")


def _repo_inputs(spark, d):
    """Files of both kinds, one request per repository and plan, and the advisories."""
    code = fixtures.derive(spark, d, fixtures.REPO_FILES).select("repo", "path", "file_ord", "content")
    rest = fixtures.requirement_files(spark, d).select("repo", "path", F.lit(0).alias("file_ord"), "content")
    files = code.unionByName(rest).withColumn("size_bytes", F.octet_length("content").cast("bigint"))
    requests = fixtures.derive(spark, d, fixtures.REPO_REQUESTS).select(
        "request_id", "repo", "plan", F.lit("build a report").alias("intent"), F.concat(F.lit("owner/"), "repo").alias("repo_name")
    )
    return files, requests


def repo_files(spark, d):
    """The files of every admitted request with their weight and weighted points."""
    reports = repo_scan.repo_file_reports(*_repo_inputs(spark, d))
    return repo.file_weights(reports).select(
        "repo", F.col("plan_applied").alias("plan"), "path", "risk", "risk_points", "file_weight", "weighted_risk_points"
    )


def repo_report(spark, d):
    return repo_scan.repo_reports(*_repo_inputs(spark, d), *_json_snapshot(spark, d)).select(
        "request_id", "repo", "repo_name", "admitted", "plan", "risk", "risk_points", "trust_score", "files_scanned_count",
        "files_scanned_limit", _joined("touches").alias("touches"),
        _joined("behavior_summary").alias("behavior_summary"), "summary", "highest_file_risk", "repo_size_bytes",
        "manifests_scanned", "dependencies_parsed", "dependencies_skipped_count", "advisory_count",
        "dependency_risk_points",
    )


# --- streams -----------------------------------------------------------------------------------------------


def _stream_folder(spark: SparkSession) -> str:
    """A fresh folder for one run, in the cluster's shared folder where there is one."""
    return f"{shared_folder(spark)}/riskframe-{uuid.uuid4()}"


def stream_usage(spark, d):
    """Daily usage kept by a stream over the events, then read back."""
    out = _stream_folder(spark)
    events = jobs.stream_table(spark, f"{d}/events*.parquet", spark.read.parquet(f"{d}/events.parquet"))
    requests = events.select(F.concat(F.lit("user:"), "user_id").alias("actor_key"), "ts")
    jobs.start_usage(requests, f"{out}/usage", f"{out}/checkpoint").awaitTermination()
    return sinks.read_usage(spark, f"{out}/usage").select(
        "actor_key", F.col("usage_date").cast("string").alias("usage_date"), "scan_count"
    )


def stream_quota(spark, d):
    """The answers of a stream over the events' requests, then read back."""
    out = _stream_folder(spark)
    events = jobs.stream_table(spark, f"{d}/events*.parquet", spark.read.parquet(f"{d}/events.parquet"))
    events.createOrReplaceTempView("arriving_events")
    requests = spark.sql(fixtures.SCAN_REQUESTS.replace("FROM events", "FROM arriving_events"))
    stream_quotas.start_quota(requests, f"{out}/answers", f"{out}/checkpoint").awaitTermination()
    return stream_quotas.decision_table(spark, f"{out}/answers").read().select("scan_id", "actor_key", "plan", "admitted")


def report_sink(spark, d):
    """Findings of the code files as the sink stores them, written twice as after a lost answer, read with their explanations."""
    out = _stream_folder(spark)
    for _ in range(2):
        sinks.write_reports(_reports(spark, d, call_sites=True).select("file_id", "findings"), out, ["file_id"])
    return sinks.read_findings(spark, out).select("file_id", "line", "pattern", "explanation", *findings.GUIDANCE_FIELDS)


def file_tree(spark, d):
    """The snippets of the code files, written as a tree of folders by repository and read back as files."""
    out = f"{_stream_folder(spark)}/tree"
    lines_of = fixtures.derive(spark, d, fixtures.CODE_FILES).select("repo", "content")
    lines_of.write.partitionBy("repo").text(out)
    read = file_source.read_file_tree(spark, out, "*.txt").select(F.substring_index("repo", "=", -1).alias("repo"), "content", "size_bytes")
    rows = read.groupBy("repo").agg(F.sum("size_bytes").alias("size_bytes"))
    found = lines.line_explode(read.select("repo", "content")).groupBy("repo").agg(F.count("*").alias("n_lines"), F.count_distinct("line").alias("n_texts"))
    return rows.join(found, "repo")


def stream_scan(spark, d):
    """The file report over a stream of the documents' code files, then read back."""
    out = _stream_folder(spark)
    documents = fixtures.dealt_out(jobs.stream_table(spark, f"{d}/documents*.parquet", spark.read.parquet(f"{d}/documents.parquet")), "documents")
    documents.createOrReplaceTempView("arriving_documents")
    files = spark.sql(fixtures.CODE_TEXTS.replace("FROM documents", "FROM arriving_documents"))
    reports = _flat_report(file_scan.file_reports(files))
    jobs.start_scan(reports, f"{out}/reports", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(reports.schema).parquet(f"{out}/reports")


QUERIES = {
    f.__name__: f
    for f in [
        scan_files, code_file_filter, manifest_filter, line_explode, exclude_blocks, strip_literals,
        part_lines, part_exclude_blocks, part_functions,
        behavior_findings, secret_findings, taint_sources, assigned_vars, taint_map, call_arguments,
        literal_arguments, trusted_network_lines, enclosing_function, sink_boost, tainted_sinks, file_heuristics,
        ast_call_sites, ast_findings, corpus_secret_scan, corpus_script_scan, corpus_focus_windows,
        all_findings, dedupe_findings, finding_explanations, file_touches, file_risk_points, trust_score,
        intent_quality, intent_mismatch, behavior_summary, focus_windows, focus_blocks, file_report,
        corpus_file_report, ranked_files, line_limit, plan_limits, account_access, repo_limits, quota_admission,
        daily_usage, usage_upsert, actor_key, parse_requirements, normalize_versions, parse_package_json,
        dedupe_dependencies, deps_skipped_top, dep_advisory_refs, dep_findings, dep_findings_ranked,
        advisory_severity, fixed_versions, dep_risk_points, dep_rollup, manifest_summary, path_weights,
        repo_url_parse, repo_risk, repo_highest_risk, repo_touches, repo_behavior, readme_badge, repo_report, repo_files,
        advisory_json, advisory_json_refs, advisory_bad_lines, manifest_files_entries, manifest_files_findings,
        program_call_sites, salted_dep_refs, indexed_word_rules, indexed_behavior, bucketed_repo_files,
        stream_usage, stream_quota, stream_scan, report_sink, file_tree,
    ]
}
