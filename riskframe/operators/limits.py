"""Plan limits and the results that report them (operators J5, C23, C24, P10, P11)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.functions.paths import is_code_file
from riskframe.rules import PlanLimits

Limits = Mapping[str, PlanLimits]


def normalized_plan(plan: Column) -> Column:
    """Lower-cased plan name; none means free."""
    return F.lower(F.coalesce(F.nullif(plan, F.lit("")), F.lit(rules.DEFAULT_PLAN)))


def role_and_plan(role: Column, plan: Column) -> Column:
    """``{role, plan}`` of an account (operator C23): an admin without a plan gets the admin plan."""
    role = F.lower(F.coalesce(F.nullif(role, F.lit("")), F.lit("user")))
    default = F.when(role == "admin", "admin").otherwise(rules.DEFAULT_PLAN)
    return F.struct(
        role.alias("role"), F.lower(F.coalesce(F.nullif(plan, F.lit("")), default)).alias("plan")
    )


def plan_table(spark: SparkSession, limits: Limits = rules.PLAN_LIMITS) -> DataFrame:
    """The plan dimension: one row per plan, null for unlimited."""
    return spark.createDataFrame(
        [(name, *row) for name, row in limits.items()],
        "limit_plan string, line_limit int, repo_file_limit int, repo_size_limit_bytes bigint, daily_scan_limit int",
    )


def with_plan_limits(rows: DataFrame, plan: str = "plan", limits: Limits = rules.PLAN_LIMITS) -> DataFrame:
    """Add the limits of each row's plan; unknown plans get the free ones (operator J5).

    The dimension has one row per plan, so it is broadcast.
    """
    name = normalized_plan(F.col(plan))
    known = F.when(name.isin(*limits), name).otherwise(rules.DEFAULT_PLAN)
    table = F.broadcast(plan_table(rows.sparkSession, limits))
    return (
        rows.withColumn("_plan_key", known)
        .join(table, F.col("_plan_key") == F.col("limit_plan"), "left")
        .drop("_plan_key", "limit_plan")
    )


def limit_of(plan: Column, field: str, limits: Limits = rules.PLAN_LIMITS) -> Column:
    """One limit of a plan as an expression, for plans that must stay free of joins."""
    name = normalized_plan(plan)
    result = F.lit(getattr(limits[rules.DEFAULT_PLAN], field)).cast("bigint")
    for known, row in limits.items():
        if known != rules.DEFAULT_PLAN:
            result = F.when(name == known, F.lit(getattr(row, field)).cast("bigint")).otherwise(result)
    return result


def line_limit_message(plan: Column, limit: Column) -> Column:
    return F.when(
        normalized_plan(plan) == "pro", F.format_string("Pro scans are limited to %d lines right now.", limit)
    ).otherwise(
        F.format_string("Free scans are limited to %d lines. Pro unlocks larger file scanning.", limit)
    )


def _capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def _size_text(limit: Column) -> Column:
    return F.when(
        limit >= 1_000_000, F.concat(F.format_number(F.floor(limit / 1_000_000), 0), F.lit(" MB"))
    ).otherwise(F.concat(F.format_number(limit, 0), F.lit(" bytes")))


def repo_limits(files: DataFrame, requests: DataFrame, limits: Limits = rules.PLAN_LIMITS) -> DataFrame:
    """Size and admission of every request (operators P11, A12, C24).

    Reads names and sizes only - column pruning keeps the contents out - and sums per repository
    with partial aggregation, so one huge repository is no bottleneck.  Requests keep a row each,
    named by ``request_id`` if they have one; a repository without files has size 0.
    """
    keys = [c for c in ("request_id",) if c in requests.columns]
    zero = F.lit(0).cast("bigint")
    code = F.when(is_code_file(F.col("path")) & ~F.endswith("path", F.lit("/")), F.col("size_bytes"))
    sizes = files.groupBy("repo").agg(
        F.count(code).alias("code_files"), F.coalesce(F.sum(code), F.lit(0)).alias("repo_size_bytes")
    )
    asked = requests.select(*keys, "repo", "plan").join(sizes, "repo", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ["code_files", "repo_size_bytes"]}
    )
    rows = with_plan_limits(asked, "plan", limits)
    too_many = F.col("code_files") > F.col("repo_file_limit")
    too_large = F.col("repo_size_bytes") > F.col("repo_size_limit_bytes")
    plan = _capitalized(normalized_plan(F.col("plan")))
    return rows.select(
        *keys, "repo", normalized_plan(F.col("plan")).alias("plan"), "code_files", "repo_size_bytes",
        "repo_file_limit", "repo_size_limit_bytes",
        F.coalesce(~(F.coalesce(too_many, F.lit(False)) | F.coalesce(too_large, F.lit(False))), F.lit(True))
        .alias("admitted"),
        F.when(too_many, "Repo file limit reached").when(too_large, "Repo size limit reached").alias("limit_title"),
        F.when(too_many, F.concat(
            plan, F.lit(" scans are limited to "), F.col("repo_file_limit").cast("string"),
            F.lit(" code files per repository. Upgrade for larger repo scans."),
        )).when(too_large, F.concat(
            plan, F.lit(" scans are limited to about "), _size_text(F.col("repo_size_limit_bytes")),
            F.lit(" of code per repository. Upgrade for larger repo scans."),
        )).alias("summary"),
    )
