"""File-level signals and touch categories (operators A9, A10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.functions import patterns
from riskframe.functions.columns import held_words, holds_any, let, matches_any, present, starting_words
from riskframe.operators.detect import HEURISTIC, HEURISTIC_RANK, finding
from riskframe.operators.lines import run_numbers

#: What the alternatives of all signals and categories start with.
WORDS = starting_words([*rules.SIGNALS.values(), *[p for _, p in rules.TOUCHES]])

# Any run that is long enough holds a whole block of half its length that starts at a multiple of that: a look at the
# first characters of each block rules out nearly all texts.
_BLOCK = (rules.BLOB_LENGTH + 1) // 2
_BLOB_BLOCK = rf"\A(?s:.{{{_BLOCK}}})*?[A-Za-z0-9+/]{{{_BLOCK}}}"
# Anchored at the start of a run: scanning stays linear, and some run is long enough either way.
_BLOB = rf"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{{{rules.BLOB_LENGTH}}}"


def first_matching_line(scan_text: Column, runs: Column, pattern: str) -> Column:
    """Number of the first kept line matching a pattern in any case, else 1."""
    lines = F.transform(
        F.split(scan_text, "\n", -1),
        lambda t, i: F.when(t.rlike("(?iu)" + patterns.jvm(pattern)), i),
    )
    index = F.get(F.filter(lines, lambda i: i.isNotNull()), F.lit(0))
    return F.coalesce(
        let(F.struct(index.alias("i"), run_numbers(runs).alias("numbers")),
            lambda b: F.coalesce(F.get(b["numbers"], b["i"]), b["i"] + 1)),
        F.lit(1),
    )


def matches(text: Column, pattern: str, words: Sequence[str], held: Column | None = None) -> Column:
    """Whether a pattern is found; it is tried only on texts that hold one of its words.

    A plain search for a word costs a fraction of the pattern, and nearly all texts hold none.  ``held`` may bring those of
    :data:`WORDS` that the text holds.
    """
    found = matches_any(text, [pattern], held)
    return found if held is not None else holds_any(text, words) & found


def text_words(text_code: Column, line_code: Column, line_words: Column) -> Column:
    """Those of :data:`WORDS` that ``text_code`` holds; nearly always it is ``line_code``, whose words are known."""
    return F.when(text_code == line_code, line_words).otherwise(held_words(text_code, WORDS))


def heuristic_findings(scan_text: Column, text_code: Column, runs: Column, held: Column | None = None) -> Column:
    """Findings from combined signals of a whole file (operator A9)."""
    signal = {name: matches(text_code, p, rules.SIGNAL_WORDS[name], held) for name, p in rules.SIGNALS.items()}
    fires = {
        "obfuscated_execution": signal["exec"] & signal["decode"],
        "download_execute_chain": signal["download"] & signal["system"],
        "high_entropy_blob": scan_text.rlike(_BLOB_BLOCK) & scan_text.rlike(_BLOB),
        "chr_chain": signal["chr"] & (F.regexp_count(text_code, F.lit(patterns.jvm(rules.SIGNALS["chr"])))
        >= rules.CHR_CHAIN_LENGTH),
    }
    return present(
        F.when(fires[key], finding(
            first_matching_line(scan_text, runs, pattern), F.lit(key), F.lit(float(points)),
            HEURISTIC_RANK, F.lit(i), F.lit(HEURISTIC), F.lit(message), F.lit(""),
        ))
        for i, (key, points, message, pattern) in enumerate(rules.HEURISTICS)
    )


def touches(text_code: Column, findings: Column, held: Column | None = None) -> Column:
    """Behaviour categories of a file in fixed order (operator A10)."""
    found = [F.when(matches(text_code, p, rules.TOUCH_WORDS[name], held), F.lit(name)) for name, p in rules.TOUCHES]
    found.append(F.when(F.exists(findings, lambda f: f["type"] == "secret"), F.lit(rules.SECRETS_TOUCH)))
    return present(found)
