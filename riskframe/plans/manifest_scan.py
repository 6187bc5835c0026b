"""Dependency manifests of repositories against the advisory snapshot (entry point E3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators import dependencies as deps
from riskframe.operators import manifests


def repo_dependencies(
    entries: DataFrame, manifest_files: DataFrame, refs: DataFrame, advisories: DataFrame
) -> DataFrame:
    """One row per repository with manifests: counters, capped points and summary sentences."""
    per_repo = deps.finding_totals(manifests.dedupe_dependencies(manifests.parsed(entries)), refs, advisories)
    counts = manifests.manifest_counts(entries, manifest_files)
    numbers = ["advisory_count", "unique_package_versions", "unique_manifest_files", "unique_vulnerability_ids"]
    zero = F.lit(0).cast("bigint")
    filled = counts.join(per_repo, "repo", "left").select(
        "repo", "manifests_scanned", "dependencies_parsed", "dependencies_queried", "dependencies_skipped_count",
        F.coalesce(deps.capped_points(F.col("cents")), F.lit(0.0)).alias("dependency_risk_points"),
        *[F.coalesce(name, zero).alias(name) for name in numbers],
    )
    return filled.withColumn("summary_lines", manifests.manifest_sentences(
        F.col("manifests_scanned"), F.col("dependencies_parsed"), F.col("dependencies_skipped_count"),
        F.col("advisory_count"), F.col("unique_package_versions"),
    ))
