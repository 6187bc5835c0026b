"""Texts, lines, and the lines that count (operators P1-P3).

A file stays one row throughout: lines live in arrays, so nothing here shuffles and the text is
read from the source exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.functions import patterns
from riskframe.functions.columns import holds_any, let, strip
from riskframe.functions.text import split_lines, strip_line_literals, strip_literals


def line_explode(files: DataFrame, text: str = "content") -> DataFrame:
    """One row per line, numbered from 1 (operator P1)."""
    keys = [c for c in files.columns if c != text]
    return files.select(
        *keys, F.posexplode(split_lines(F.col(text))).alias("pos", "line")
    ).select(*keys, (F.col("pos") + 1).alias("line_no"), "line")


def strip_literals_per_line(files: DataFrame, text: str = "content") -> DataFrame:
    """One row per line with its lower-cased form free of literals (operator P3)."""
    lines = F.array_join(split_lines(F.col(text)), "\n")
    keys = [c for c in files.columns if c != text]
    return files.select(
        *keys, F.posexplode(F.split(strip_line_literals(F.lower(lines)), "\n", -1)).alias("pos", "code")
    ).select(*keys, (F.col("pos") + 1).alias("line_no"), "code")


def kept_runs(
    lines: Column,
    blocks: Sequence[tuple] = tuple(rules.EXCLUDED_BLOCKS),
    functions: Sequence[str] = tuple(rules.EXCLUDED_FUNCTIONS),
) -> Column:
    """Runs ``{first, last}`` of line numbers outside the excluded blocks (operator P2).

    One fold over the lines carries the open blocks as a bit set (the lowest bit claims the line),
    two brace depths and the start of the current run.  Only a finished run grows the result, so
    the cost follows the lines and not their square.
    """
    delta_of = lambda t: F.length(F.regexp_replace(t, r"[^{]", "")) - F.length(F.regexp_replace(t, r"[^}]", ""))

    def marker(t: Column) -> Column:
        result = F.lit(0)
        for bit, (start, also, _) in reversed(list(enumerate(blocks))):
            opens = F.startswith(t, F.lit(start)) & F.contains(t, F.lit(also))
            result = F.when(opens, F.lit(1 << bit)).otherwise(result)
        return result

    def function_start(t: Column) -> Column:
        names = "|".join(patterns.literal(name) for name in functions)
        return t.rlike(rf"\Afunction (?:{names})\(") if functions else F.lit(False)

    facts = F.transform(
        lines,
        lambda raw, i: let(
            strip(raw),
            lambda t: F.struct(
                (i + 1).alias("n"), t.alias("t"), delta_of(raw).alias("delta"),
                marker(t).alias("opens"), function_start(t).alias("fn"),
            ),
        ),
    )

    def ends(state: Column, fact: Column, claimed: Column) -> Column:
        result = F.lit(False)
        for bit, (_, _, closers) in enumerate(blocks):
            done = (state["depth"] + fact["delta"] <= 0) if closers is None else fact["t"].isin(*closers)
            result = F.when(claimed == F.lit(1 << bit), done).otherwise(result)
        return result

    balanced = sum(1 << bit for bit, (_, _, closers) in enumerate(blocks) if closers is None)

    def step(state: Column, fact: Column) -> Column:
        in_function = (state["fn_depth"] > 0) | (fact["fn"] & (fact["delta"] > 0))
        claimed = state["open"].bitwiseAND(-state["open"])
        in_block = state["open"] > 0
        opens = fact["opens"]
        fn_depth = F.when(
            in_function, F.greatest(F.lit(0), F.greatest(F.lit(0), state["fn_depth"]) + fact["delta"])
        ).otherwise(F.lit(0))
        open_bits = (
            F.when(in_function, state["open"])
            .when(opens > 0, state["open"].bitwiseOR(opens))
            .when(in_block & ends(state, fact, claimed), state["open"] - claimed)
            .otherwise(state["open"])
        )
        depth = (
            F.when(in_function, state["depth"])
            .when(opens.bitwiseAND(F.lit(balanced)) > 0, fact["delta"])
            .when(in_block & (claimed.bitwiseAND(F.lit(balanced)) > 0),
                  F.greatest(F.lit(0), state["depth"] + fact["delta"]))
            .otherwise(state["depth"])
        )
        keep = ~in_function & (opens == 0) & ~in_block
        closes_run = ~keep & (state["first"] > 0)
        return F.struct(
            fn_depth.cast("int").alias("fn_depth"),
            open_bits.cast("int").alias("open"),
            depth.cast("int").alias("depth"),
            F.when(~keep, F.lit(0)).when(state["first"] > 0, state["first"])
            .otherwise(fact["n"]).cast("int").alias("first"),
            fact["n"].cast("int").alias("n"),
            F.when(closes_run, F.array_append(
                state["runs"],
                F.struct(state["first"].alias("first"), (fact["n"] - 1).cast("int").alias("last")),
            )).otherwise(state["runs"]).alias("runs"),
        )

    start = F.struct(
        F.lit(0).alias("fn_depth"), F.lit(0).alias("open"), F.lit(0).alias("depth"),
        F.lit(0).alias("first"), F.lit(0).alias("n"),
        F.array().cast("array<struct<first:int,last:int>>").alias("runs"),
    )
    return F.aggregate(
        facts, start, step,
        lambda s: F.when(s["first"] > 0, F.array_append(
            s["runs"], F.struct(s["first"].alias("first"), s["n"].alias("last"))
        )).otherwise(s["runs"]),
    )


def _has_blocks(text: Column, blocks: Sequence[tuple], functions: Sequence[str]) -> Column:
    named = F.contains(text, F.lit("function ")) & holds_any(text, [f"function {name}(" for name in functions])
    return holds_any(text, [start for start, _, _ in blocks]) | named


def with_scannable(
    files: DataFrame,
    text: str = "content",
    blocks: Sequence[tuple] = tuple(rules.EXCLUDED_BLOCKS),
    functions: Sequence[str] = tuple(rules.EXCLUDED_FUNCTIONS),
) -> DataFrame:
    """Add the line arrays the detectors read.

    ``all_lines``  every line of the text;
    ``runs``       kept line runs, or null where no excluded block can be (nearly every file);
    ``scan_text``  kept lines joined by a line feed;
    ``line_code``  the same, lower-cased and stripped of literals line by line;
    ``text_code``  the same, stripped of literals as one text and lower-cased.
    """
    with_lines = files.withColumn("all_lines", split_lines(F.col(text)))
    with_runs = with_lines.withColumn(
        "runs",
        F.when(_has_blocks(F.col(text), blocks, functions), kept_runs(F.col("all_lines"), blocks, functions)),
    )
    kept = _lines_of(F.col("all_lines"), F.col("runs"))
    return _with_code(with_runs.withColumn(
        "scan_text",
        F.array_join(F.when(F.col("runs").isNotNull(), kept).otherwise(F.col("all_lines")), "\n"),
    ))


def _lines_of(lines: Column, runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.slice(lines, r["first"], r["last"] - r["first"] + 1)))


def _with_code(joined: DataFrame) -> DataFrame:
    quoted = F.contains(F.col("scan_text"), F.lit("'")) | F.contains(F.col("scan_text"), F.lit('"'))
    lower = F.lower(F.col("scan_text"))
    with_code = joined.withColumn("line_code", F.when(quoted, strip_line_literals(lower)).otherwise(lower))
    return with_code.withColumn(
        "text_code", F.when(quoted, F.lower(strip_literals(F.col("scan_text")))).otherwise(F.col("line_code"))
    )


def with_thin_scannable(
    files: DataFrame,
    text: str,
    facts: Callable[[Column, Column], Column],
    blocks: Sequence[tuple] = tuple(rules.EXCLUDED_BLOCKS),
    functions: Sequence[str] = tuple(rules.EXCLUDED_FUNCTIONS),
) -> DataFrame:
    """:func:`with_scannable`, but all texts besides ``all_lines`` hold a placeholder for each line that cannot matter.

    ``facts`` makes the struct of :func:`riskframe.operators.python_facts.scan_facts` of a text and of what counts of it; it is
    added as ``facts``.
    """
    runs = F.when(_has_blocks(F.col(text), blocks, functions), kept_runs(split_lines(F.col(text)), blocks, functions))
    counting = F.when(F.col("runs").isNotNull(), F.array_join(_lines_of(split_lines(F.col(text)), F.col("runs")), "\n"))
    with_facts = files.withColumn("runs", runs).withColumn("facts", facts(F.col(text), counting))
    with_lines = with_facts.withColumn("all_lines", split_lines(F.col(text), F.col("facts.broken")))
    return _with_code(with_lines.withColumn("scan_text", F.col("facts.thin")))


def run_numbers(runs: Column) -> Column:
    """The line numbers of all kept runs, in order."""
    return F.flatten(F.transform(runs, lambda r: F.sequence(r["first"], r["last"])))


def scannable_lines(files: DataFrame, **blocks: Sequence) -> DataFrame:
    """One row per line outside the excluded blocks (operator P2)."""
    keys = [c for c in files.columns if c != "content"]
    numbers = F.when(F.col("runs").isNotNull(), run_numbers(F.col("runs"))).otherwise(
        F.transform(F.col("all_lines"), lambda _, i: i + 1)
    )
    row = F.arrays_zip(numbers.alias("line_no"), F.split("scan_text", "\n", -1).alias("line"))
    return (
        with_scannable(files, **blocks)
        .select(*keys, F.explode(F.slice(row, F.lit(1), F.size(numbers))).alias("row"))
        .select(*keys, "row.line_no", "row.line")
    )
