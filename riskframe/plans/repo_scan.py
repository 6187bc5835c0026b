"""The repository report: admission, file reports, dependencies, verdict (entry point E2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.functions.paths import is_code_file, is_manifest, repo_of_url
from riskframe.functions.scores import readme_badge, trust_badge
from riskframe.operators import limits, manifests, repo
from riskframe.plans.file_scan import file_reports
from riskframe.plans.manifest_scan import repo_dependencies
from riskframe.rules import BehaviorRule, SecretRule


def parsed_requests(requests: DataFrame) -> DataFrame:
    """Add ``owner``, ``repo_short`` and ``repo_name``, or ``error`` for a bad address (operator C11)."""
    named = requests.withColumn("_r", repo_of_url(F.col("repo_url")))
    return named.select(
        *requests.columns, F.col("_r.owner").alias("owner"), F.col("_r.repo").alias("repo_short"),
        F.concat(F.col("_r.owner"), F.lit("/"), F.col("_r.repo")).alias("repo_name"),
        F.when(F.col("_r").isNull(), F.lit(rules.REPO_URL_ERROR)).alias("error"),
    )


def repo_file_reports(
    files: DataFrame,
    requests: DataFrame,
    plan_limits: limits.Limits = rules.PLAN_LIMITS,
    verdicts: DataFrame | None = None,
    behavior: Sequence[BehaviorRule] = tuple(rules.BEHAVIOR_RULES),
    secrets: Sequence[SecretRule] = tuple(rules.SECRET_RULES),
    call_sites: bool = True,
) -> DataFrame:
    """File reports of all admitted requests, keyed by ``repo``, ``intent`` and ``plan_applied``.

    A repository that several requests name with one intent and plan is scanned once for all of
    them.  Admission reads metadata only (or takes ``verdicts`` at hand).  The join that applies it
    has no broadcast hint, as the number of repositories is not bounded: adaptive execution
    broadcasts the verdicts when they are small and otherwise splits the partitions of a huge
    repository.
    """
    if verdicts is None:
        verdicts = limits.repo_limits(files.select("repo", "path", "size_bytes"), requests, plan_limits)
    admitted = verdicts.where("admitted").select("request_id")
    chosen = requests.join(admitted, "request_id", "left_semi").select(
        "repo", "intent", limits.normalized_plan(F.col("plan")).alias("plan")
    ).distinct()
    code = files.where(is_code_file(F.col("path"))).select("repo", "path", "file_ord", "content")
    return file_reports(
        code.join(chosen, "repo"), behavior, secrets, call_sites, plan_limits=plan_limits
    )


def repo_reports(
    files: DataFrame,
    requests: DataFrame,
    refs: DataFrame,
    advisories: DataFrame,
    plan_limits: limits.Limits = rules.PLAN_LIMITS,
    call_sites: bool = True,
    entries: DataFrame | None = None,
    manifest_names: DataFrame | None = None,
) -> DataFrame:
    """One row per request.

    ``files``: ``repo, path, file_ord, size_bytes, content``; ``requests``: ``request_id, repo,
    repo_name, intent, plan`` (``request_id`` unique).  A repository that is requested several times
    gets a report for each request, one without files an empty report.  Details stay in the file-report and finding tables.  Manifest ``entries`` and
    ``manifest_names`` that are already at hand can be given; else they are parsed from ``files``.
    """
    verdicts = limits.repo_limits(files.select("repo", "path", "size_bytes"), requests, plan_limits)
    rolled = repo.rollup_files(
        repo_file_reports(files, requests, plan_limits, verdicts, call_sites=call_sites),
        "repo", "intent", "plan_applied",
    ).select(F.col("repo").alias("_repo"), F.col("intent").alias("_intent"), "*").drop("repo", "intent")
    if entries is None:
        manifest_files = files.where(is_manifest(F.col("path"))).select("repo", "path", "content")
        entries = manifests.manifest_entries(manifest_files)
        manifest_names = manifest_files.select("repo", "path")
    dependencies = repo_dependencies(entries, manifest_names, refs, advisories)
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    names = requests.select("request_id", "repo_name", "intent")
    same = (
        (F.col("repo") == F.col("_repo")) & F.col("intent").eqNullSafe(F.col("_intent"))
        & (F.col("plan") == F.col("plan_applied"))
    )
    joined = (
        names.join(verdicts, "request_id").join(rolled, same, "left").drop("_repo", "_intent", "plan_applied")
        .join(dependencies, "repo", "left")
    )
    counters = [
        "manifests_scanned", "dependencies_parsed", "dependencies_queried", "dependencies_skipped_count",
        "advisory_count", "unique_package_versions", "unique_manifest_files", "unique_vulnerability_ids",
    ]
    filled = joined.withColumns({
        **{c: F.coalesce(c, zero) for c in ["files_scanned_count", "weighted_points", *counters]},
        "dependency_risk_points": F.coalesce("dependency_risk_points", F.lit(0.0)),
        "highest_file_risk": F.coalesce("highest_file_risk", F.lit("green")),
        **{c: F.coalesce(c, none) for c in ["touches", "behavior_summary", "summary_lines"]},
    })
    scored = repo.with_repo_score(filled)
    ok = F.col("admitted")
    touches = F.array_sort(F.when(
        F.col("advisory_count") > 0, F.array_append("touches", F.lit(rules.DEPENDENCIES_TOUCH))
    ).otherwise(F.col("touches")))
    sentences = repo.repo_sentences(
        F.col("behavior_summary"), F.col("files_scanned_count"), F.col("advisory_count"),
        F.col("unique_package_versions"), F.col("summary_lines"),
    )
    badge = readme_badge(F.col("repo_name"), F.col("trust_score"))
    return scored.select(
        "request_id", "repo", "repo_name", "intent", "admitted", "plan", "limit_title",
        F.when(ok, F.col("risk")).otherwise("limit").alias("risk"),
        F.when(ok, F.col("trust_score")).otherwise(0).alias("trust_score"),
        F.when(ok, F.col("trust_badge")).otherwise(trust_badge(F.lit(0), F.lit("red"))).alias("trust_badge"),
        F.when(ok, badge).alias("readme_badge"),
        F.when(ok, F.col("files_scanned_count")).otherwise(zero).alias("files_scanned_count"),
        F.coalesce(F.col("repo_file_limit").cast("string"), F.lit("Unlimited")).alias("files_scanned_limit"),
        F.when(ok, touches).otherwise(none).alias("touches"),
        F.when(ok, sentences).otherwise(none).alias("behavior_summary"),
        F.when(ok, F.format_string(
            "Weighted repo scan completed across %d files.", F.col("files_scanned_count")
        )).otherwise(F.col("summary")).alias("summary"),
        F.when(ok, F.col("risk_points")).otherwise(100.0).alias("risk_points"),
        F.when(ok, F.col("highest_file_risk")).otherwise("green").alias("highest_file_risk"),
        "repo_size_bytes", "repo_size_limit_bytes",
        *[F.when(ok, F.col(c)).alias(c) for c in [*counters, "dependency_risk_points", "summary_lines"]],
    )
