"""Many rules at once: only rules whose keyword stands in a line are tried on it (operators P4, P5).

A rule's keywords are whole words, one of which every match of its pattern holds. Lines meet a table of rules through their words, so
the cost of a line follows its words and the rules that they name, not the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions import patterns
from riskframe.functions.columns import rows_of
from riskframe.rules import BehaviorRule, SecretRule

RULE_SCHEMA = "seq int, keywords array<string>, jvm string, type string, key string, message string, points double"

#: Keywords that are tried on every line as one alternation; more of them are only met through the join.
FEW_WORDS = 64

# In front of a word, so that no other word character can stand there, and behind it.
_BEFORE, _BEHIND = r"(?:\\b|\\\.|\(\?<!\[\\w\.\]\))", r"(?=\\b|\\\.|\\\(|\\s\*\\\()"
_WORD = re.compile(rf"{_BEFORE}([A-Za-z0-9_]+){_BEHIND}")
_WORDS = re.compile(rf"{_BEFORE}\(([A-Za-z0-9_|]+)\){_BEHIND}")


def keywords(pattern: str) -> list[str]:
    """Whole words, in lower case, one of which every match of the pattern holds; none if the pattern is not plain enough to tell."""
    choice = _WORDS.search(pattern)
    rest = _WORDS.sub("", pattern).replace(r"(?<![\w.])", "")
    for escaped in (r"\(", r"\)", r"\|", r"\[", r"\]", r"\{", r"\?", r"\*", r"\s*", r"\s+"):
        rest = rest.replace(escaped, "")
    if re.search(r"[(|\[{?*]", rest):
        return []
    words = _WORD.findall(pattern)
    if words:
        return [max(words, key=len).lower()]
    return sorted(set(choice[1].lower().split("|"))) if choice else []


def rule_table(spark: SparkSession, rules: Iterable[BehaviorRule | SecretRule], type_: str) -> DataFrame:
    """One row per rule that has keywords."""
    rows = [
        (seq, keywords(r.pattern), patterns.jvm(r.pattern), type_, r.key, getattr(r, "message", None) or r.label, float(r.points))
        for seq, r in enumerate(rules) if keywords(r.pattern)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def word_rules(words: DataFrame, type_: str, points: float = 1.0) -> DataFrame:
    """A rule for each lower-case ``word`` of a table, which matches the word alone."""
    word = F.col("word")
    return words.select(
        F.lit(0).alias("seq"), F.array(word).alias("keywords"),
        F.concat(F.lit(f"(?<![{patterns.WORD}])"), word, F.lit(f"(?![{patterns.WORD}])")).alias("jvm"),
        F.lit(type_).alias("type"), word.alias("key"), F.concat(F.lit("Names "), word).alias("message"), F.lit(points).alias("points"),
    )


def indexed_hits(lines: DataFrame, rules: DataFrame, text: str = "code", known: Sequence[str] | None = None) -> DataFrame:
    """Lines with each rule that matches them: the other columns of ``lines``, ``seq, type, pattern, message, points``.

    ``rules``: rows of ``RULE_SCHEMA``, any number; Spark broadcasts them while they are small. A line that holds several keywords of
    a rule meets it at the first of them only. ``known``: the keywords of all rules, if they are few enough to stand in the plan;
    other words then make no rows.
    """
    names = [c for c in lines.columns if c != text]
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"([{patterns.WORD}]+)"), F.lit(1)))
    if known is not None:
        lines = lines.where(F.lower(text).rlike("|".join(known)) if known else F.lit(False))
        words = F.array_intersect(words, F.array(*map(F.lit, known)).cast("array<string>"))
    spread = lines.withColumn("words", words).withColumn("keyword", F.explode(rows_of("words")))
    met = spread.join(rules.withColumn("keyword", F.explode("keywords")), "keyword")
    first = (F.size("keywords") == 1) | (F.get(F.array_intersect("words", "keywords"), F.lit(0)) == F.col("keyword"))
    return met.where(first).where(F.expr(f"{text} RLIKE jvm")).select(*names, "seq", "type", F.col("key").alias("pattern"), "message", "points")


def rule_hits(lines: DataFrame, rules: Sequence[BehaviorRule | SecretRule], type_: str, text: str = "code") -> DataFrame:
    """:func:`indexed_hits` of a list of rules; those without keywords are tried behind one alternation of their patterns."""
    names = [c for c in lines.columns if c != text]
    # A list at hand is sent to the lines, which are not shuffled; of a short one, only the words that it names make rows.
    known = sorted({word for r in rules for word in keywords(r.pattern)})
    found = indexed_hits(lines, F.broadcast(rule_table(lines.sparkSession, rules, type_)), text, known if len(known) <= FEW_WORDS else None)
    plain = [(seq, r) for seq, r in enumerate(rules) if not keywords(r.pattern)]
    if not plain:
        return found
    hits = F.array(*[
        F.when(F.col(text).rlike(patterns.jvm(r.pattern)), F.struct(
            F.lit(seq).alias("seq"), F.lit(type_).alias("type"), F.lit(r.key).alias("pattern"),
            F.lit(getattr(r, "message", None) or r.label).alias("message"), F.lit(float(r.points)).alias("points"),
        )) for seq, r in plain
    ])
    gated = lines.where(F.col(text).rlike(patterns.any_of(r.pattern for _, r in plain)))
    return found.unionByName(gated.select(*names, F.explode(rows_of(hits)).alias("h")).select(*names, "h.*"))
