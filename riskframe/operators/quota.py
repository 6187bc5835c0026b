"""Actors, daily quotas and usage (operators C22, W5, A11, S5, C24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.functions.columns import strip
from riskframe.operators.limits import Limits, normalized_plan, with_plan_limits

USAGE_KEYS = ["actor_key", "usage_date"]


def actor_key(user_id: Column, forwarded_for: Column, client_host: Column, user_agent: Column) -> Column:
    """``user:<id>``, or a digest of host and user agent for anonymous requests (operator C22)."""
    forwarded = F.nullif(strip(F.substring_index(F.coalesce(forwarded_for, F.lit("")), ",", 1)), F.lit(""))
    host = F.coalesce(forwarded, client_host, F.lit("unknown"))
    digest = F.sha2(F.concat(host, F.lit("|"), F.coalesce(user_agent, F.lit(""))), 256)
    known = F.nullif(user_id.cast("string"), F.lit(""))
    return F.coalesce(F.concat(F.lit("user:"), known), F.concat(F.lit("anon:"), digest))


def admit(
    requests: DataFrame, usage: DataFrame | None = None, limits: Limits = rules.PLAN_LIMITS
) -> DataFrame:
    """Add ``admitted`` and, for refused requests, the text of the refusal (operators W5, C24).

    A request is admitted while its actor's admitted requests of the day stay below the limit of
    the request's own plan; plans without a limit are always admitted and never counted.
    ``usage`` brings in counts of earlier batches.

    The admitted requests of one limit are the first ones of that limit, so at most ``limit`` rows
    per actor, day and limit decide everything.  They are cut out before the shuffle (a literal
    bound on the row number), walked in order, and leave one last-admitted position per limit; all
    requests are then compared with it.  An actor with a third of all requests therefore never
    gathers in one task: only the final equi-join sees the key, and adaptive execution splits it.
    """
    limited = with_plan_limits(requests, "plan", limits).drop(
        "line_limit", "repo_file_limit", "repo_size_limit_bytes"
    )
    caps = sorted({p.daily_scan_limit for p in limits.values() if p.daily_scan_limit is not None})
    if not caps:
        return limited.withColumn("admitted", F.lit(True))
    position = F.struct("ts", "scan_id")
    group = [*USAGE_KEYS, "daily_scan_limit"]
    heads = (
        limited.where(F.col("daily_scan_limit").isNotNull())
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy("ts", "scan_id")))
        .where(F.col("_rank") <= caps[-1])
        .where(F.col("_rank") <= F.col("daily_scan_limit"))
    )
    walks = heads.groupBy(*USAGE_KEYS).agg(
        F.array_sort(F.collect_list(F.struct(position.alias("at"), F.col("daily_scan_limit").alias("cap"))))
        .alias("walk")
    )
    if usage is None:
        walks = walks.withColumn("_used", F.lit(0))
    else:
        walks = walks.join(
            usage.select(*USAGE_KEYS, F.col("scan_count").cast("int").alias("_used")), USAGE_KEYS, "left"
        ).withColumn("_used", F.coalesce("_used", F.lit(0)))

    start = F.struct(F.col("_used").alias("used"), F.slice("walk", 1, 0).alias("kept"))

    def step(state: Column, request: Column) -> Column:
        free = state["used"] < request["cap"]
        return F.struct(
            F.when(free, state["used"] + 1).otherwise(state["used"]).alias("used"),
            F.when(free, F.array_append(state["kept"], request)).otherwise(state["kept"]).alias("kept"),
        )

    kept = walks.select(*USAGE_KEYS, F.aggregate("walk", start, step, lambda s: s["kept"]).alias("kept"))
    last = [
        F.struct(
            F.lit(cap).alias("daily_scan_limit"),
            F.array_max(_positions("kept", cap)).alias("_last"),
        )
        for cap in caps
    ]
    cutoffs = kept.select(*USAGE_KEYS, F.explode(F.array(*last)).alias("c")).select(*USAGE_KEYS, "c.*")
    joined = limited.join(cutoffs.where(F.col("_last").isNotNull()), group, "left")
    admitted = F.col("daily_scan_limit").isNull() | F.coalesce(position <= F.col("_last"), F.lit(False))
    label = F.when(normalized_plan(F.col("plan")) == "free", "Free").otherwise("Pro")
    return joined.withColumn("admitted", admitted).drop("_last").withColumns({
        "limit_title": F.when(~F.col("admitted"), F.concat(label, F.lit(" daily scan limit reached"))),
        "limit_summary": F.when(~F.col("admitted"), F.concat(
            label, F.lit(" allows up to "), F.col("daily_scan_limit").cast("string"),
            F.lit(" scans per day. Try again tomorrow or upgrade for higher limits."),
        )),
    })


def _positions(kept: str, cap: int) -> Column:
    return F.transform(F.filter(kept, lambda r: r["cap"] == cap), lambda r: r["at"])


def daily_usage(admitted: DataFrame) -> DataFrame:
    """Counted scans per actor and day (operator A11)."""
    counted = admitted.where(F.col("admitted") & F.col("daily_scan_limit").isNotNull())
    return counted.groupBy(*USAGE_KEYS).agg(
        F.max_by(normalized_plan(F.col("plan")), F.struct("ts", "scan_id")).alias("plan"),
        F.count(F.lit(1)).alias("scan_count"),
    )


def upsert_usage(snapshot: DataFrame, new: DataFrame) -> DataFrame:
    """Merge new counts into a usage snapshot (operator S5).

    Both sides have one row per actor and day, so the join cannot skew.
    """
    old = snapshot.select(*USAGE_KEYS, F.col("plan").alias("_plan"), F.col("scan_count").alias("_count"))
    zero = F.lit(0).cast("bigint")
    return old.join(new, USAGE_KEYS, "full").select(
        *USAGE_KEYS, F.coalesce("plan", "_plan").alias("plan"),
        (F.coalesce("_count", zero) + F.coalesce("scan_count", zero)).alias("scan_count"),
    )
