"""File reports rolled up to repositories (operators A2-A5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.functions.columns import present, round2
from riskframe.functions.paths import code_percent
from riskframe.functions.scores import risk_level, trust_badge, trust_score

_SENTENCES = [
    *rules.BEHAVIOR_SENTENCES.values(), *rules.CHAIN_SENTENCES.values(), rules.MISMATCH_SENTENCE,
    rules.QUIET_SENTENCE,
]
_TOUCHES = [name for name, _ in rules.TOUCHES] + [rules.SECRETS_TOUCH]
_RISKS = ["green", "yellow", "red"]
_STEP = 64  # more than the sentences of one file


def file_weights(reports: DataFrame) -> DataFrame:
    """Add a file's path weight and weighted points (operator C9)."""
    weight = code_percent(F.col("path")) / F.lit(100.0)
    return reports.withColumns({
        "file_weight": weight, "weighted_risk_points": round2(F.col("risk_points") * weight),
    })


def rollup_files(reports: DataFrame, *scope: str) -> DataFrame:
    """One row per repository (or other ``scope`` columns) from its file reports (operators A2-A5).

    Categories, sentences and risk levels come from short fixed lists, so every union, maximum and
    first occurrence is a fixed-width aggregate: one shuffle, combined on the map side, with
    nothing collected - a repository with a third of all files costs no more than its rows.
    Points and weights are summed as whole hundredths, so the result does not depend on order.
    """
    scope = scope or ("repo",)
    risk = F.lit(0)
    for rank, name in enumerate(_RISKS):
        risk = F.when(F.col("risk") == name, F.lit(rank)).otherwise(risk)
    weighted = F.round(F.col("risk_points") * 100).cast("bigint") * code_percent(F.col("path"))
    aggregates = [
        F.count(F.lit(1)).alias("files_scanned_count"),
        F.sum(weighted).alias("weighted_points"),
        F.max(risk).alias("risk_rank"),
    ]
    aggregates += [
        F.max(F.array_contains("touches", touch)).alias(f"touch_{i}") for i, touch in enumerate(_TOUCHES)
    ]
    aggregates += [
        F.min(F.when(
            F.array_contains("behavior_summary", sentence),
            F.col("file_ord").cast("bigint") * _STEP + F.array_position("behavior_summary", sentence),
        )).alias(f"sentence_{i}")
        for i, sentence in enumerate(_SENTENCES)
    ]
    rolled = reports.groupBy(*scope).agg(*aggregates)
    first_seen = F.array_sort(present(
        F.when(F.col(f"sentence_{i}").isNotNull(),
               F.struct(F.col(f"sentence_{i}").alias("at"), F.lit(text).alias("text")))
        for i, text in enumerate(_SENTENCES)
    ))
    highest = F.lit(_RISKS[0])
    for rank, name in enumerate(_RISKS[1:], start=1):
        highest = F.when(F.col("risk_rank") == rank, F.lit(name)).otherwise(highest)
    return rolled.select(
        *scope, "files_scanned_count", "weighted_points", highest.alias("highest_file_risk"),
        F.array_sort(present(
            F.when(F.col(f"touch_{i}"), F.lit(touch)) for i, touch in enumerate(_TOUCHES)
        )).alias("touches"),
        F.transform(first_seen, lambda s: s["text"]).alias("behavior_summary"),
    )


def repo_points(weighted_points: Column, file_count: Column, dependency_points: Column) -> Column:
    """Damped repository score (operator A2)."""
    mean = (weighted_points / F.lit(10_000.0)) / F.greatest(F.lit(1), file_count)
    raw = mean + dependency_points
    damped = None
    for start, percent in rules.REPO_DAMPING:
        value = raw * F.lit(percent / 100)
        damped = F.when(raw >= start, value) if damped is None else damped.when(raw >= start, value)
    return damped.otherwise(raw)


def with_repo_score(rolled: DataFrame) -> DataFrame:
    """Add score, bucket, trust and badge; expects ``dependency_risk_points``."""
    scored = rolled.withColumn("points", repo_points(
        F.col("weighted_points"), F.col("files_scanned_count"), F.col("dependency_risk_points")
    ))
    points = F.col("points")
    return scored.withColumns({
        "risk": risk_level(points), "trust_score": trust_score(points),
        "trust_badge": trust_badge(trust_score(points), risk_level(points)),
        "risk_points": round2(points),
    }).drop("points")


def repo_sentences(
    files: Column, count: Column, advisories: Column, packages: Column, manifest_lines: Column
) -> Column:
    """Behaviour lines of a repository: file lines first seen first, then its own (operator A5)."""
    own = present([
        F.when(advisories > 0, F.format_string(
            "Contains %d dependency advisory finding(s) across %d package/version pair(s).", advisories, packages
        )),
        F.when((count > 0) & (advisories == 0), F.lit(rules.NO_MAJOR_SENTENCE)),
        F.when(advisories > 0, F.lit(rules.DEPENDENCIES_SENTENCE)),
    ])
    lines = F.array_distinct(F.concat(files, own, manifest_lines))
    return F.when(F.size(lines) == 0, F.array(F.lit(rules.QUIET_REPO_SENTENCE))).otherwise(lines)
