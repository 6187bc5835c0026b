"""Variables fed by outside data (operators P6, C1, W6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.functions import patterns
from riskframe.functions.columns import let, matches_any, rows_of
from riskframe.operators.lines import line_explode, with_scannable
from riskframe.operators.python_facts import python_facts

_ASSIGNMENT = patterns.jvm(r"\A" + rules.ASSIGNMENT_PATTERN)


def is_source(lower_line: Column, sources: Sequence[str] = tuple(rules.TAINT_SOURCES)) -> Column:
    return lower_line.rlike(patterns.any_of(sources))


def assigned_variable(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, _ASSIGNMENT, 1), F.lit(""))


def with_sources(scan_text: Column, sources: Sequence[str] = tuple(rules.TAINT_SOURCES)) -> Column:
    """The text if it reads outside data at all; nothing is tainted in any other."""
    reads = let(F.lower(scan_text), lambda text: matches_any(text, sources))
    return F.when(reads, scan_text)


def taint_map(files: DataFrame, sources: Sequence[str] = tuple(rules.TAINT_SOURCES)) -> DataFrame:
    """One row per tainted variable and file, in first-taint order (operator W6)."""
    keys = [c for c in files.columns if c != "content"]
    facts = python_facts(scan_text=with_sources(F.col("scan_text"), sources), sources=sources)
    return with_scannable(files).withColumn("facts", facts).select(
        *keys, F.posexplode(rows_of("facts.tainted")).alias("pos", "variable")
    )


def taint_sources(files: DataFrame, sources: Sequence[str] = tuple(rules.TAINT_SOURCES)) -> DataFrame:
    """Lines that read outside data (operator P6)."""
    return line_explode(files).where(is_source(F.lower("line"), sources))


def assigned_variables(files: DataFrame) -> DataFrame:
    """Lines that assign a variable, with its name (operator C1)."""
    return line_explode(files).withColumn("variable", assigned_variable(F.col("line"))).where(
        F.col("variable").isNotNull()
    )
