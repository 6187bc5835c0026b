"""Union, dedupe and explanation of findings (operators U1, W1, O1, J3, J4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import texts
from riskframe.functions.columns import let, rows_of
from riskframe.operators.detect import no_findings

GUIDANCE_FIELDS = ["why_risky", "what_to_check", "when_legitimate", "suggested_fix"]


def union_findings(*parts: Column) -> Column:
    """All findings of a file: line rules, call sites, heuristics (operator U1)."""
    return F.concat(*[F.coalesce(p, no_findings()) for p in parts])


def dedupe(findings: Column) -> Column:
    """The strongest finding per line and key, ordered by line and key (operators W1, O1).

    Works inside the file's row: sort, then keep every element whose key differs from its
    predecessor's.  Equal severities prefer line rules, then call sites, then heuristics.
    """
    ordered = F.array_sort(F.transform(
        findings,
        lambda f: F.struct(
            f["line"].alias("line"), f["pattern"].alias("pattern"), (-f["severity"]).alias("order"),
            f["src_rank"].alias("src_rank"), f["seq"].alias("seq"), f.alias("finding"),
        ),
    ))
    kept = let(ordered, lambda rows: F.filter(
        rows,
        lambda x, i: (i == 0) | (F.get(rows, i - 1)["line"] != x["line"])
        | (F.get(rows, i - 1)["pattern"] != x["pattern"]),
    ))
    return F.transform(kept, lambda x: x["finding"])


def finding_rows(files: DataFrame, findings: str = "findings", keys: list[str] | None = None) -> DataFrame:
    """One row per finding of a report."""
    keys = keys or ["file_id"]
    return files.select(*keys, F.explode(rows_of(findings)).alias("f")).select(*keys, "f.*")


def explanation_table(spark: SparkSession) -> DataFrame:
    """``pattern -> explanation``: about thirty fixed rows."""
    return spark.createDataFrame(list(texts.EXPLANATIONS.items()), "pattern string, base_explanation string")


def guidance_table(spark: SparkSession) -> DataFrame:
    """``pattern ->`` the four guidance texts: about thirty fixed rows."""
    rows = [(key, *group[1:]) for group in texts.GUIDANCE for key in group[0]]
    return spark.createDataFrame(
        rows, "pattern string, " + ", ".join(f"{name} string" for name in GUIDANCE_FIELDS)
    )


def explain_findings(findings: DataFrame) -> DataFrame:
    """Add explanation and guidance to finding rows (operators J3, J4).

    Both sides of the lookup are fixed tables of some thirty rows, so they are broadcast; rows
    with an unknown key get the default texts.
    """
    spark = findings.sparkSession
    joined = findings.join(F.broadcast(explanation_table(spark)), "pattern", "left").join(
        F.broadcast(guidance_table(spark)), "pattern", "left"
    )
    base = F.coalesce(F.col("base_explanation"), F.lit(texts.DEFAULT_EXPLANATION))
    explained = {"explanation": F.concat_ws(" ", base, F.nullif(F.col("note"), F.lit("")))}
    for name, default in zip(GUIDANCE_FIELDS, texts.DEFAULT_GUIDANCE):
        explained[name] = F.coalesce(F.col(name), F.lit(default))
    return joined.withColumns(explained).drop("base_explanation")
