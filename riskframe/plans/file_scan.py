"""The file report: one row per file in, one row per file out (entry point E1).

The whole report is a chain of projections over the file's row plus one Arrow step that thins the
text to the lines that matter and finds call sites.  There is no shuffle, no join and a single read of the text; findings, windows and
sentences are nested arrays that the ``*_rows`` helpers explode when a flat table is wanted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.functions.columns import round2, starting_words
from riskframe.functions.patterns import branches, starts
from riskframe.functions.scores import risk_level, trust_badge, trust_score
from riskframe.functions.text import split_lines
from riskframe.operators import detect, findings, focus, heuristics, intent, limits
from riskframe.operators.callsites import call_findings, gated
from riskframe.operators.lines import with_scannable, with_thin_scannable
from riskframe.operators.python_facts import scan_facts
from riskframe.operators.thinning import RUN
from riskframe.rules import BehaviorRule, SecretRule

LIMIT_POINTS = 100.0


def _words(behavior: Sequence[BehaviorRule], secrets: Sequence[SecretRule], heuristic: bool) -> list[str] | None:
    """Words of which a line must hold one, in any case, to match a rule, a signal or a category; none if some rule has no such word."""
    searched = [r.pattern for r in secrets]
    if heuristic:
        blob = next(p for key, _, _, p in rules.HEURISTICS if key == "high_entropy_blob")
        searched += [*rules.SIGNALS.values(), *[p for _, p in rules.TOUCHES], *[p for *_, p in rules.HEURISTICS if p != blob]]
    if not all(r.hint for r in behavior) or not all(starts(b) for p in searched for b in branches(p)):
        return None
    return [*detect.hints(behavior), *starting_words(searched)]


def with_findings(
    files: DataFrame,
    text: str = "content",
    behavior: Sequence[BehaviorRule] = tuple(rules.BEHAVIOR_RULES),
    secrets: Sequence[SecretRule] = tuple(rules.SECRET_RULES),
    call_sites: bool = True,
    heuristic: bool = True,
) -> DataFrame:
    """Add ``findings`` (all) and the text columns the rest of the report reads."""
    words = _words(behavior, secrets, heuristic)
    facts = None if words is None else lambda content, counting: scan_facts(
        content, counting, words, detect.hints([r for r in behavior if r.key in rules.SINK_KEYS]), call_sites,
        min(RUN, rules.BLOB_LENGTH),
    )
    scanned = with_scannable(files, text) if facts is None else with_thin_scannable(files, text, facts)
    hit = detect.with_hits(scanned, behavior, secrets, heuristics.WORDS if heuristic else ())
    if heuristic:
        held = heuristics.text_words(F.col("text_code"), F.col("line_code"), F.col("line_words"))
        hit = hit.withColumn("text_words", held)
    if facts is None:
        hit = detect.with_facts(hit, behavior, gated(F.col(text)) if call_sites else None)
    else:
        hit = detect.with_used(hit).withColumn("call_sites", F.col("facts.sites"))
    parts = [detect.line_findings(F.col("hits"), F.col("scan_text"), F.col("runs"), F.col("used"))]
    if call_sites:
        parts.append(call_findings(F.col("call_sites")))
    if heuristic:
        parts.append(heuristics.heuristic_findings(
            F.col("scan_text"), F.col("text_code"), F.col("runs"), F.col("text_words")
        ))
    return hit.withColumn("all_findings", findings.union_findings(*parts))


def file_reports(
    files: DataFrame,
    behavior: Sequence[BehaviorRule] = tuple(rules.BEHAVIOR_RULES),
    secrets: Sequence[SecretRule] = tuple(rules.SECRET_RULES),
    call_sites: bool = True,
    context_lines: int = 2,
    plan_limits: limits.Limits = rules.PLAN_LIMITS,
) -> DataFrame:
    """Full report per file.

    ``files`` needs ``intent`` and ``content``; a ``plan`` column brings the line limit in.  All
    other columns pass through.
    """
    keys = [c for c in files.columns if c not in ("intent", "content", "plan")]
    limited = "plan" in files.columns
    plan = F.col("plan") if limited else F.lit("admin")
    counted = files.withColumn("line_limit", limits.limit_of(plan, "line_limit", plan_limits))
    if limited:
        # A file over its limit is refused before any work on it: its text goes no further.
        counted = counted.withColumn("line_count", F.size(split_lines(F.col("content"))))
        counted = counted.withColumn("over_limit", F.coalesce(F.col("line_count") > F.col("line_limit"), F.lit(False)))
        counted = counted.withColumn("content", F.when(F.col("over_limit"), "").otherwise(F.col("content")))
    found = with_findings(counted, "content", behavior, secrets, call_sites)
    over = F.col("over_limit") if limited else F.lit(False)
    line_count = F.col("line_count") if limited else F.size("all_lines")

    deduped = found.select(
        *keys, "intent", plan.alias("plan"), "line_limit", "all_lines", "text_code", "text_words", over.alias("over_limit"),
        line_count.alias("line_count"),
        findings.dedupe(F.col("all_findings")).alias("findings"),
    )
    touched = deduped.withColumn("touches", heuristics.touches(F.col("text_code"), F.col("findings"), F.col("text_words")))
    judged = touched.withColumn("mismatches", intent.mismatches(F.col("intent"), F.col("touches")))
    points = round2(
        F.aggregate("findings", F.lit(0.0), lambda s, f: s + f["severity"])
        + F.aggregate("mismatches", F.lit(0.0), lambda s, m: s + m["penalty"])
    )
    scored = judged.withColumn("raw_points", points)

    over = F.col("over_limit")
    none = F.array().cast("array<string>")

    def unless_over(column, otherwise):
        return F.when(over, otherwise).otherwise(column) if limited else column

    risk_points = unless_over(F.col("raw_points"), F.lit(LIMIT_POINTS))
    report = scored.select(
        *keys, "intent",
        unless_over(risk_level(F.col("raw_points")), F.lit("limit")).alias("risk"),
        risk_points.alias("risk_points"),
        unless_over(trust_score(F.col("raw_points")), F.lit(0)).alias("trust_score"),
        unless_over(
            trust_badge(trust_score(F.col("raw_points")), risk_level(F.col("raw_points"))),
            trust_badge(F.lit(0), F.lit("red")),
        ).alias("trust_badge"),
        unless_over(F.col("touches"), none).alias("touches"),
        unless_over(F.col("findings"), detect.no_findings()).alias("findings"),
        unless_over(F.transform("mismatches", lambda m: m["message"]), none).alias("intent_mismatches"),
        unless_over(
            intent.behavior_sentences(F.col("touches"), F.col("findings"), F.size("mismatches")), none
        ).alias("behavior_summary"),
        unless_over(
            F.format_string(
                "%d suspicious patterns detected and %d intent mismatch warnings",
                F.size("findings"), F.size("mismatches"),
            ),
            limits.line_limit_message(plan if not limited else F.col("plan"), F.col("line_limit")),
        ).alias("summary"),
        F.when(
            ~over, focus.focus_blocks(focus.flagged_lines(F.col("findings")), F.col("all_lines"), context_lines)
        ).alias("focused_code_blocks"),
        "line_count",
        *(
            [limits.normalized_plan(F.col("plan")).alias("plan_applied"), "line_limit"] if limited else []
        ),
    )
    return report
