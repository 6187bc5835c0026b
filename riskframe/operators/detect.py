"""Rule matches on lines and their context-aware severity (operators P4, P5, P7, P8, C2-C5, W2, J6).

Findings of a file are an array built from the file's own row: ``gate -> candidate lines -> hits
-> scored findings``.  The gate is the list of words that a file holds, so files without any rule
keyword (nearly all of a large corpus) stop there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import rules, texts
from riskframe.functions import patterns
from riskframe.functions.columns import contains_any, held_words, let, lookup, matches_any, present, quoted, round2, strip
from riskframe.operators.lines import run_numbers
from riskframe.operators.python_facts import python_facts
from riskframe.operators.taint import is_source, with_sources
from riskframe.rules import BehaviorRule, SecretRule

BEHAVIOR = "suspicious_behavior"
SECRET = "secret"
HEURISTIC = "heuristic"

LINE_RANK, CALL_RANK, HEURISTIC_RANK = 0, 1, 2

_LITERAL = patterns.jvm(r"""\A\s*["'].*["']\s*\z""")
_DYNAMIC = "|".join(patterns.literal(m) for m in rules.DYNAMIC_MARKERS)
_FUNCTION = patterns.jvm(r"\A" + rules.FUNCTION_PATTERN)

FINDING = (
    "struct<line:int,pattern:string,severity:double,src_rank:int,seq:int,type:string,message:string,note:string>"
)


def no_findings() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def finding(line, pattern, severity, src_rank, seq, type_, message, note) -> Column:
    """One finding of a file; severity is clamped at zero and kept at two decimals (C5)."""
    return F.struct(
        line.cast("int").alias("line"), pattern.alias("pattern"),
        round2(F.greatest(F.lit(0.0), severity.cast("double"))).alias("severity"),
        F.lit(src_rank).alias("src_rank"), seq.cast("int").alias("seq"),
        type_.alias("type"), message.alias("message"), note.cast("string").alias("note"),
    )


def call_pattern(key: str) -> str | None:
    """The pattern that captures the arguments of a call to ``key``, if it can be read off a line."""
    if key not in rules.CALL_KEYS:
        return None
    member = r"(?:\.[A-Za-z_][A-Za-z0-9_]*)?" if key in rules.MEMBER_CALL_KEYS else ""
    return patterns.jvm(patterns.literal(key.rstrip("(")) + member + r"\s*\((.*)\)")


def call_arguments(line: Column, key: str) -> Column:
    """Trimmed text between the call's parenthesis and the last one of the line (operator C2)."""
    pattern = call_pattern(key)
    return F.lit("") if pattern is None else strip(F.regexp_extract(line, pattern, 1))


def is_literal_argument(args: Column) -> Column:
    return args.rlike(_LITERAL)


def is_trusted_network_line(line: Column) -> Column:
    return contains_any(F.lower(line), rules.TRUSTED_NETWORK_HINTS)


def function_name(line: Column) -> Column:
    """The name that a ``def`` line defines, else an empty text."""
    return F.regexp_extract(line, _FUNCTION, 1)


def function_starts(scan_text: Column, numbers: Column) -> Column:
    """``{line, name}`` of every ``def`` line in order."""
    return F.filter(
        F.transform(
            F.split(scan_text, "\n", -1),
            lambda t, i: F.struct(
                F.coalesce(F.get(numbers, i), i + 1).alias("line"),
                function_name(t).alias("name"),
            ),
        ),
        lambda d: d["name"] != "",
    )


def enclosing_function(starts: Column, line: Column) -> Column:
    """Name of the last ``def`` at or before a line, else an empty text (operator W2).

    ``starts`` are in line order, so their number up to the line is found bit by bit: a binary search.
    """
    bits = F.when(F.size(starts) > 0, F.sequence(F.floor(F.log2(F.size(starts))).cast("int"), F.lit(0), F.lit(-1)))

    def search(at: Column, bit: Column) -> Column:
        ahead = at + F.pow(F.lit(2), bit).cast("int")
        return F.when(F.get(starts, ahead - 1)["line"] <= line, ahead).otherwise(at)

    return let(F.aggregate(bits, F.lit(0), search), lambda n: F.coalesce(F.get(starts, n - 1)["name"], F.lit("")))


def literal_discount(key: Column) -> Column:
    return lookup(
        {k: float(v) for k, v in rules.LITERAL_DISCOUNTS.items()}, key, float(rules.DEFAULT_LITERAL_DISCOUNT)
    )


def sink_context(key: Column, line: Column, args: Column, used: Column) -> Column:
    """``{boost, note, variable}`` of a dangerous call on a line (operators C3, J6); ``used``: the first tainted variable in it."""
    facts = F.struct(
        (args != "").alias("called"), is_literal_argument(args).alias("literal"),
        args.rlike(_DYNAMIC).alias("built"), is_source(F.lower(line)).alias("source"),
        used.alias("variable"),
    )

    def score(f: Column) -> Column:
        dynamic = f["called"] & ~f["literal"]
        fixed = f["called"] & f["literal"] & ~f["built"] & ~f["source"] & f["variable"].isNull()
        boost = (
            F.when(dynamic, 4.0).otherwise(0.0)
            + F.when(f["built"], 4.0).otherwise(0.0)
            + F.when(f["source"], 12.0).otherwise(0.0)
            + F.when(f["variable"].isNotNull(), 12.0).otherwise(0.0)
            - F.when(fixed, literal_discount(key)).otherwise(0.0)
        )
        note = F.concat_ws(
            " ",
            F.when(dynamic, texts.NOTE_DYNAMIC), F.when(f["built"], texts.NOTE_BUILT),
            F.when(f["source"], texts.NOTE_SOURCE),
            F.when(f["variable"].isNotNull(), F.format_string(texts.NOTE_TAINTED, f["variable"])),
            F.when(fixed, texts.NOTE_LITERAL),
        )
        return F.struct(boost.alias("boost"), note.alias("note"), f["variable"].alias("variable"))

    return let(facts, score)


def hints(behavior: Sequence[BehaviorRule]) -> list[str]:
    """The plain texts that behaviour rules name, each once."""
    return list(dict.fromkeys(h for r in behavior if r.hint for h in r.hint.split("|")))


def _candidates(behavior: Sequence[BehaviorRule], secrets: Sequence[SecretRule]) -> Column:
    """Lines that can match some rule: ``{line, text, code}``.

    A line is asked only for the hints that its file holds, nearly always few of them, and for patterns that the file matches.
    """
    named = F.array(*map(F.lit, hints(behavior))).cast("array<string>")
    plain = patterns.any_of(r.pattern for r in behavior if not r.hint)
    secret = patterns.any_of(r.pattern for r in secrets)

    def matches(text: Column, pattern: str) -> Column:
        return text.rlike(pattern) if pattern else F.lit(False)

    file_gates = F.struct(
        F.array_intersect("line_words", named).alias("hints"), matches(F.col("line_code"), plain).alias("code"),
        matches_any(F.col("scan_text"), [r.pattern for r in secrets]).alias("text"),
    )

    def line_gate(c: Column, gates: Column) -> Column:
        return (
            F.exists(gates["hints"], lambda h: F.contains(c["code"], h))
            | (gates["code"] & matches(c["code"], plain)) | (gates["text"] & matches(c["text"], secret))
        )

    # Bound once per file, outside the per-line lambda.
    texts_and_numbers = F.struct(
        F.split("scan_text", "\n", -1).alias("texts"), run_numbers(F.col("runs")).alias("numbers")
    )
    lines = let(
        texts_and_numbers,
        lambda b: F.transform(
            F.split("line_code", "\n", -1),
            lambda code, i: F.struct(
                F.coalesce(F.get(b["numbers"], i), i + 1).cast("int").alias("line"),
                F.get(b["texts"], i).alias("text"), code.alias("code"),
            ),
        ),
    )
    return let(file_gates, lambda g: F.when(
        (F.size(g["hints"]) > 0) | g["code"] | g["text"], F.filter(lines, lambda c: line_gate(c, g))
    ))


def _hits(behavior: Sequence[BehaviorRule], secrets: Sequence[SecretRule]) -> Column:
    """Rule matches of the ``candidates`` lines, one per line and rule, in rule order.

    Written as SQL text: one expression for all rules instead of some hundred column calls.
    """

    def hit(side, pattern, seq, type_, rule, message, args, sink, network) -> str:
        return f"""CASE WHEN c.{side} RLIKE {quoted(patterns.jvm(pattern))} THEN named_struct(
            'line', c.line, 'seq', {seq}, 'type', {quoted(type_)}, 'key', {quoted(rule.key)},
            'message', {quoted(message)}, 'points', {quoted(float(rule.points))}, 'args', {args},
            'sink', {quoted(sink)}, 'network', {quoted(network)}, 'text', c.text) END"""

    def args_of(key: str) -> str:
        pattern = call_pattern(key)
        if pattern is None:
            return "''"
        ends = rf"^[{patterns.SPACE}]+|[{patterns.SPACE}]+\z"
        return f"regexp_replace(regexp_extract(c.text, {quoted(pattern)}, 1), {quoted(ends)}, '')"

    found = [
        hit("code", r.pattern, i, BEHAVIOR, r, r.message, args_of(r.key),
            r.key in rules.SINK_KEYS, r.key in rules.TRUSTED_NETWORK_KEYS)
        for i, r in enumerate(behavior)
    ] + [
        hit("text", r.pattern, len(behavior) + i, SECRET, r, r.label, "''", False, False)
        for i, r in enumerate(secrets)
    ]
    return F.expr(
        f"flatten(transform(candidates, c -> filter(array({', '.join(found)}), h -> h IS NOT NULL)))"
    )


def with_hits(
    scanned: DataFrame,
    behavior: Sequence[BehaviorRule] = tuple(rules.BEHAVIOR_RULES),
    secrets: Sequence[SecretRule] = tuple(rules.SECRET_RULES),
    words: Sequence[str] = (),
) -> DataFrame:
    """Add ``hits`` to the output of :func:`riskframe.operators.lines.with_scannable`.

    ``line_words`` are the hints, and those of ``words``, that ``line_code`` holds.
    """
    if not behavior and not secrets:
        raise ValueError("at least one rule is needed")
    searched = scanned.withColumn("line_words", held_words(F.col("line_code"), [*hints(behavior), *words]))
    return searched.withColumn("candidates", _candidates(behavior, secrets)).withColumn(
        "hits", _hits(behavior, secrets)
    ).drop("candidates")


def with_facts(hits: DataFrame, behavior: Sequence[BehaviorRule], code: Column | None = None) -> DataFrame:
    """Add ``used``, the first tainted variable in the arguments of each hit, and ``call_sites`` of ``code`` (operators W6, F1).

    The text of a file goes to Python only if it has a dangerous call and reads outside data.
    """
    if code is None and not any(r.key in rules.SINK_KEYS for r in behavior):
        return hits.withColumn("used", F.lit(None).cast("array<string>"))
    sinks = F.exists("hits", lambda h: h["sink"])
    args = F.transform("hits", lambda h: F.when(h["sink"], h["args"]))
    facts = python_facts(code, F.when(sinks, with_sources(F.col("scan_text"))), F.when(sinks, args))
    added = hits.withColumn("facts", facts).withColumn("used", F.col("facts.used"))
    return (added if code is None else added.withColumn("call_sites", F.col("facts.sites"))).drop("facts")


def with_used(hits: DataFrame) -> DataFrame:
    """Add ``used`` as :func:`with_facts` does, from the tainted variables that ``facts`` already holds."""

    def first_used(args: Column, names: Column) -> Column:
        words = F.regexp_extract_all(F.lower(args), F.lit(f"[{patterns.WORD}]+"), F.lit(0))
        return F.get(let(words, lambda held: F.filter(names, lambda n: F.array_contains(held, F.lower(n)))), F.lit(0))

    return hits.withColumn("used", F.when(F.size("facts.tainted") > 0, F.transform(
        "hits", lambda h: F.when(h["sink"], first_used(h["args"], F.col("facts.tainted")))
    )))


def line_findings(hits: Column, scan_text: Column, runs: Column, used: Column) -> Column:
    """Findings of the line rules with context-aware severity.

    Function names are only derived for files with a hit that needs them.
    """
    context = F.struct(
        hits.alias("hits"), used.alias("used"),
        F.when(F.exists(hits, lambda h: h["network"]), let(
            run_numbers(runs), lambda numbers: function_starts(scan_text, numbers)
        )).alias("functions"),
    )

    def score(h: Column, i: Column, c: Column) -> Column:
        sink = F.when(h["sink"], sink_context(h["key"], h["text"], h["args"], F.get(c["used"], i)))
        trusted = h["network"] & (
            enclosing_function(c["functions"], h["line"]).isin(*rules.TRUSTED_NETWORK_FUNCTIONS)
            | is_trusted_network_line(h["text"])
        )

        def of(s: Column) -> Column:
            raw = h["points"] + F.coalesce(s["sink"]["boost"], F.lit(0.0))
            note = F.concat_ws(
                " ", F.when(s["trusted"], texts.NOTE_TRUSTED), F.nullif(s["sink"]["note"], F.lit(""))
            )
            severity = F.when(s["trusted"], F.greatest(F.lit(0.25), raw - 2)).otherwise(raw)
            return finding(h["line"], h["key"], severity, LINE_RANK, h["seq"], h["type"], h["message"], note)

        return let(F.struct(sink.alias("sink"), F.coalesce(trusted, F.lit(False)).alias("trusted")), of)

    return F.when(F.size(hits) > 0, let(
        context, lambda c: F.transform(c["hits"], lambda h, i: score(h, i, c))
    )).otherwise(no_findings())


# --- row-shaped operators -------------------------------------------------------------------------


def call_argument_rows(lines: DataFrame) -> DataFrame:
    """Arguments of every readable call on exploded lines (operator C2)."""
    found = present(
        F.when(F.col("line").rlike(call_pattern(key)), F.struct(
            F.lit(key).alias("pattern"), call_arguments(F.col("line"), key).alias("args")
        ))
        for key in rules.CALL_KEYS
    )
    keys = [c for c in lines.columns if c != "line"]
    return lines.select(*keys, F.explode(found).alias("c")).select(*keys, "c.*")


def sink_rows(scanned: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Boost, note and tainted variable of every dangerous call (operators C3, J6).

    ``scanned`` is the output of :func:`riskframe.operators.lines.with_scannable`.
    """
    sinks = [r for r in rules.BEHAVIOR_RULES if r.key in rules.SINK_KEYS]
    hits = with_facts(with_hits(scanned, sinks, ()), sinks)
    scored = let(
        F.struct("hits", "used"),
        lambda c: F.transform(c["hits"], lambda h, i: F.struct(
            h["line"].alias("line"), h["key"].alias("pattern"), h["args"].alias("args"),
            sink_context(h["key"], h["text"], h["args"], F.get(c["used"], i)).alias("context"),
        )),
    )
    return hits.select(*keys, F.explode(scored).alias("s")).select(
        *keys, "s.line", "s.pattern", "s.args", "s.context.*"
    )


def enclosing_function_rows(scanned: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """The function every kept line belongs to (operator W2).

    ``def`` lines cut the text into spans, and each span is unrolled into its lines: linear in the
    text and without the shuffle a window over all lines would need.
    """
    starts = F.filter(
        F.transform(F.split("scan_text", "\n", -1), lambda t, i: F.struct(
            i.alias("at"), function_name(t).alias("name")
        )),
        lambda d: (d["name"] != "") | (d["at"] == 0),
    )
    spans = let(
        F.struct(starts.alias("starts"), F.size(F.split("scan_text", "\n", -1)).alias("n")),
        lambda b: F.transform(b["starts"], lambda d, k: F.struct(
            d["name"].alias("name"), d["at"].alias("first"),
            (F.coalesce(F.get(b["starts"], k + 1)["at"], b["n"]) - 1).alias("last"),
        )),
    )
    # A text without lines is one empty text when split.
    rows = scanned.where(F.size("all_lines") > 0).select(*keys, "runs", F.explode(spans).alias("s"))
    numbers = F.coalesce(
        F.slice(run_numbers(F.col("runs")), F.col("s.first") + 1, F.col("s.last") - F.col("s.first") + 1),
        F.sequence(F.col("s.first") + 1, F.col("s.last") + 1),
    )
    return rows.select(*keys, F.explode(numbers).alias("line_no"), F.col("s.name").alias("function"))
