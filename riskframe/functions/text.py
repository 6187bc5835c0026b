"""Line splitting and string-literal stripping as JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.functions.columns import holds_any, let

# Every separator Python's str.splitlines knows.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# Those but the line feed; nearly all texts hold none, and a split at line feeds takes no pattern.
_RARE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def split_lines(text: Column, broken: Column | None = None) -> Column:
    """Lines of ``text`` as an array, without a trailing empty line.

    ``broken`` may tell whether the text holds other line breaks than line feeds.
    """
    return let(
        F.when(holds_any(text, _RARE_BREAKS) if broken is None else broken, F.split(text, LINE_BREAK, -1)).otherwise(F.split(text, "\n", -1)),
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts),
    )


def _strip(text: Column, breaks: str) -> Column:
    # Possessive loops: a backtracking one recurses per character on the JVM and overflows the
    # stack on a long literal.
    any_char = r"[^\n]" if breaks else r"[\s\S]"

    def without(mark: str, pattern: str) -> Callable[[Column], Column]:
        return lambda t: F.when(F.contains(t, F.lit(mark)), F.regexp_replace(t, pattern, "")).otherwise(t)

    for mark, pattern in (
        ("'''", rf"'''{any_char}*?'''"),
        ('"""', rf'"""{any_char}*?"""'),
        ("'", rf"'(?:[^'\\{breaks}]++|\\[^\n])*+'"),
        ('"', rf'"(?:[^"\\{breaks}]++|\\[^\n])*+"'),
    ):
        text = let(text, without(mark, pattern))
    return text


def strip_literals(text: Column) -> Column:
    """Delete quoted literals from a whole text; they may span lines."""
    return _strip(text, "")


def strip_line_literals(text: Column) -> Column:
    """Delete quoted literals line by line from a text whose only separator is ``\\n``."""
    return _strip(text, r"\n")
