"""Focus windows and blocks around flagged lines (operators W3, J7, J8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.functions.columns import let


def flagged_lines(findings: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(findings, lambda f: f["line"])))


def focus_windows(flagged: Column, line_count: Column, context: int = 2) -> Column:
    """Merged ``{start_line, end_line}`` windows around sorted flagged lines (operator W3).

    Windows touch or overlap exactly if their lines are at most ``2 * context + 1`` apart, so the
    lines after a wider gap start a window and the ones before it end one.
    """

    def window(a: Column, b: Column) -> Column:
        return F.struct(
            F.greatest(F.lit(1), a["line"] - context).cast("int").alias("start_line"),
            F.least(line_count, b["line"] + context).cast("int").alias("end_line"),
        )

    return let(flagged, lambda lines: _groups(lines, context, window))


def _groups(lines: Column, context: int, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the first and the last ``{line, at}`` of each window; ``at``: place among the flagged lines."""
    reach = 2 * context + 1
    placed = F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("at")))
    first = F.filter(placed, lambda p: (p["at"] == 0) | (p["line"] - F.get(lines, p["at"] - 1) > reach))
    last = F.filter(placed, lambda p: (p["at"] == F.size(lines) - 1) | (F.get(lines, p["at"] + 1) - p["line"] > reach))
    return F.zip_with(first, last, body)


def focus_blocks(flagged: Column, all_lines: Column, context: int = 2) -> Column:
    """Windows with their lines, each marked as flagged or not (operators J7, J8).

    A window is put together from its flagged lines and the gaps after them, so the work follows
    the number of lines shown.
    """

    def block(a: Column, z: Column, b: Column) -> Column:
        start = F.greatest(F.lit(1), a["line"] - context).cast("int")
        end = F.least(F.size(b["lines"]), z["line"] + context).cast("int")

        def shown(numbers: Column, flagged: bool) -> Column:
            return F.transform(numbers, lambda n: F.struct(
                n.cast("int").alias("line"), F.get(b["lines"], n - 1).alias("content"), F.lit(flagged).alias("flagged"),
            ))

        def between(low: Column, high: Column) -> Column:
            return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))

        def piece(at: Column) -> Column:
            line = F.get(b["flagged"], at)
            until = F.when(at < z["at"], F.get(b["flagged"], at + 1) - 1).otherwise(end)
            return F.concat(
                shown(between(line, F.least(line, end)), True), shown(between(line + 1, F.least(until, end)), False)
            )

        lead = shown(between(start, F.least(a["line"] - 1, end)), False)
        pieces = F.flatten(F.transform(F.sequence(a["at"], z["at"]), piece))
        return F.struct(start.alias("start_line"), end.alias("end_line"), F.concat(lead, pieces).alias("lines"))

    return let(
        F.struct(flagged.alias("flagged"), all_lines.alias("lines")),
        lambda b: _groups(b["flagged"], context, lambda a, z: block(a, z, b)),
    )
