"""Personal data: fixed forms, and identifiers that bootstrapped contexts discover. DataFrame functions only.

1. The fixed forms (email, ip, card, phone) are found by possessive patterns, so every text costs time in proportion to its length.
   They are the seed entities.
2. Every word that a fixed form overlaps is a seed. Its lexical patterns are the word before, the word after, and both. Two kinds
   of patterns are left out: those that meet fewer than ``min_seeds`` distinct seeds, and those where less than ``min_share`` of
   all words of the corpus that stand in them are seeds ("before the"). Candidates are all words that stand in one of the others.
3. Patterns and candidate values form a graph. A pattern scores by the share of private values among the distinct values it meets
   (one value is added to the divisor, so rare patterns stay low); a value that is no seed takes the score of its best pattern,
   damped. This is repeated ``ROUNDS`` times, each round being two grouped aggregations over the written edges.
4. Patterns of at least ``min_score`` mark the words of ``min_length`` or more characters that they meet, and that no fixed form
   overlaps, as kind ``context``. Only texts that hold such a pattern are cut into words with their places.

The patterns are 64-bit hashes. Words meet them where the texts are read while there are no more than ``BROADCAST``, which are
counted first, and by a shuffle beyond that. A pattern and a value that meet very often are one row per task before any shuffle.

Positions count characters (code points), ends are exclusive. Null texts count as empty. Rows that repeat an id keep a row each. No
seed, no discovery; an empty table gives no rows. Extra columns are ignored, whatever their names. Values and patterns of any
frequency are only aggregated, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import let, rows_of
from riskframe.llm.common import table, whole_text
from riskframe.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
ROUNDS, DAMPING = 3, 0.8
MIN_SCORE, MIN_SEEDS, MIN_SHARE, MIN_LENGTH = 0.8, 3, 0.1, 6

#: Pattern hashes (8 MB) that may be broadcast.
BROADCAST = 1_000_000

#: The fixed forms. A match may start where the one before ended or where its first run of characters starts; other starts would
#: only repeat a failure. Possessive runs give the same matches, as what follows a run never belongs to it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for its kind.
_GATES = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_IP = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_WORD = r"[^ ]++"
_DIGITS = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
_BLOCK = 256

Pieces = "array<struct<start:bigint,end:bigint,value:string>>"


def running_totals(numbers: Column) -> Column:
    """Sums of the first 1, 2, ... numbers, block by block, so that long arrays are not copied for each element."""
    zero = F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _BLOCK).cast("int")), lambda b: F.slice(numbers, b * _BLOCK + 1, F.lit(_BLOCK)))

    def totals(values: Column, start: Column) -> Column:
        return F.aggregate(values, F.array(start), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    def within(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda acc, x: acc + x))
        return F.flatten(F.zip_with(blocks, F.slice(totals(sums, zero), F.lit(1), F.size(blocks)), lambda block, start: F.slice(totals(block, start), F.lit(2), F.size(block))))

    return F.when(F.size(numbers) > 0, let(blocks, within)).otherwise(F.array().cast("array<bigint>"))


def _located(gaps: Column, hits: Column) -> Column:
    """``start, end, value`` of each hit, from the text between hits."""
    lengths = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda hit, gap: (F.length(hit) + F.length(gap)).cast("long"))
    ended = let(lengths, running_totals)
    return F.zip_with(hits, ended, lambda hit, end: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("value")))


def spans(text: Column, pattern: str, gate: Column) -> Column:
    """``start, end, value`` of the leftmost non-overlapping matches, if the gate lets the text pass."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = let(hits, lambda hits: F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), lambda gaps: _located(gaps, hits))))
    return F.coalesce(F.when(gate, found), F.array().cast(Pieces))


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits; every second digit from the right is doubled, and nines are cast out."""
    doubled = F.translate(digits, "0123456789", "0246813579")
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.substr(F.when(i % 2 == 1, doubled).otherwise(digits), n - i, F.lit(1)).cast("int"))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def fixed_forms(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``text``) and an array ``start, end, value`` for each kind."""
    has_digit = F.col("text").rlike("[0-9]")
    for kind in KINDS:
        gate = F.contains("text", F.lit(_GATES[kind])) if _GATES[kind] else F.lit(True)
        gate = gate if kind == "email" else gate & has_digit
        rows = rows.withColumn(kind, _checked(kind, spans(F.col("text"), PATTERNS[kind], gate)))
    return rows


def _checked(kind: str, found: Column) -> Column:
    return F.filter(found, lambda s: _valid(kind, s["value"]))


def _plain(text: Column) -> Column:
    return F.translate(text, "\t\n\x0b\x0c\r", "     ")


def _trimmed(word: Column) -> Column:
    """The word without the punctuation at its edges."""
    return F.regexp_replace(word, _EDGES, "")


def neighbours(plain: Column, *beside: Column) -> Column:
    """``before, after`` of each word of a text without other blanks than spaces, and what stands ``beside`` each word.

    ``before`` and ``after``: the neighbouring words, lower-cased, those with a digit as 0; empty at the ends of the text.
    """
    names = F.split(F.regexp_replace(F.lower(F.trim(plain)), _DIGITS, "0"), " ++", -1)
    none = F.array(F.lit(""))

    def zipped(names: Column) -> Column:
        before, after = F.concat(none, F.slice(names, F.lit(1), F.size(names) - 1)), F.concat(F.slice(names, F.lit(2), F.size(names)), none)
        return F.arrays_zip(before.alias("before"), after.alias("after"), *beside)

    return F.when(F.trim(plain) != "", let(names, zipped))


def split_words(text: Column) -> Column:
    """``before, after, word`` of each word."""
    return let(_plain(text), lambda plain: neighbours(plain, F.split(F.trim(plain), " ++", -1).alias("word")))


def words(text: Column) -> Column:
    """``before, after, word`` (``start, value``) of each word."""
    return let(_plain(text), lambda plain: let(F.regexp_extract_all(plain, F.lit(_WORD), F.lit(0)), lambda hits: let(F.split(plain, _WORD, -1), lambda gaps: neighbours(
        plain, F.transform(_located(gaps, hits), lambda at: F.struct(at["start"].alias("start"), at["value"].alias("value"))).alias("word")))))


def placed(word: Column) -> Column:
    """``start, end, value`` of a word of ``words`` without the punctuation at its edges."""
    value = _trimmed(word["value"])
    start = word["start"] + F.length(word["value"]) - F.length(F.regexp_replace(word["value"], r"^[^\p{L}\p{N}]+", ""))
    return let(F.struct(start.alias("start"), value.alias("value")), lambda w: F.struct(w["start"].alias("start"), (w["start"] + F.length(w["value"])).alias("end"), w["value"].alias("value")))


def _patterns(c: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), c["before"]), F.xxhash64(F.lit(2), c["after"]), F.xxhash64(F.lit(3), c["before"], c["after"])]


def patterns_of(c: Column) -> Column:
    return F.array(*_patterns(c))


def met(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """The rows of ``found`` (with ``c``: ``before, after``) once for each of the written ``patterns`` that they stand in."""
    if patterns.count() > BROADCAST:
        rows = found.withColumn("pattern", F.explode(patterns_of(F.col("c"))))
        return rows.join(patterns, "pattern").select(*found.columns, "pattern")
    rows, names = found, ("known1", "known2", "known3")
    for i, name in enumerate(names):
        rows = rows.join(F.broadcast(patterns.select(F.col("pattern").alias(name))), _patterns(F.col("c"))[i] == F.col(name), "left")
    # Most words stand in none.
    rows = rows.filter(" or ".join(f"{name} is not null" for name in names))
    return rows.select(*found.columns, F.explode(rows_of(F.array(*names))).alias("pattern"))


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, scratch: Scratch | None = None) -> DataFrame:
    """``pattern, score, n_seeds`` from distinct ``pattern, value, seed``."""
    scratch = scratch or Scratch(edges.sparkSession)
    values = edges.select("pattern", "value", F.col("seed").cast("double").alias("known"))
    scored = None
    for _ in range(rounds):
        if scored is None:
            held = values.withColumn("belief", F.col("known"))
        else:
            best = values.join(scored, "pattern").groupBy("value").agg(F.greatest(F.max("known"), DAMPING * F.max("score")).alias("belief"))
            held = values.join(scratch.write(best, "beliefs"), "value")
        scored = held.groupBy("pattern").agg((F.sum("belief") / (F.count("*") + 1)).alias("score"), F.sum("known").cast("long").alias("n_seeds"))
        scored = scratch.write(scored, "scores")
        scratch.drop("beliefs")
        scratch.drop("scores", but_last=True)
    return scored


def telling_patterns(texts: DataFrame, seeds: DataFrame, min_seeds: int, min_share: float, scratch: Scratch) -> DataFrame:
    """The written ``pattern`` of those that meet enough distinct seeds, which are a large enough share of the words they meet.

    ``seeds``: ``pattern, value, n`` (how often the seed stands in the pattern). Words are counted pattern by pattern in each task.
    """
    frequent = seeds.groupBy("pattern").agg(F.count("*").alias("n_seeds"), F.sum("n").alias("n")).filter(F.col("n_seeds") >= min_seeds)
    frequent = scratch.write(frequent.select("pattern", "n"), "frequent")
    single = texts.select(F.explode(let(_plain(F.col("text")), lambda plain: neighbours(plain))).alias("c"))
    met_words = met(single, frequent.select("pattern")).groupBy("pattern").agg(F.count("*").alias("n_words"))
    return scratch.write(frequent.join(met_words, "pattern").filter(F.col("n") >= min_share * F.col("n_words")).select("pattern"), "telling")


def personal_data(
    rows: DataFrame, rounds: int = ROUNDS, min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS, min_share: float = MIN_SHARE,
    min_length: int = MIN_LENGTH,
) -> DataFrame:
    """``doc_id``, an array ``start, end, value`` for each fixed kind, and one ``context`` of discovered identifiers, for every row."""
    scratch = Scratch(rows.sparkSession)
    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("key1"), F.xxhash64(F.lit(1), "text").alias("key2"), "text")
    fixed = F.concat(*[F.transform(k, lambda s: F.struct(s["start"], s["end"])) for k in KINDS])

    def overlaps(c: Column, f: Column) -> Column:
        return F.exists(f, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))

    # The words of a text are listed only if it holds a fixed form.
    seeds = let(fixed, lambda f: F.when(F.size(f) > 0, F.filter(words(F.col("text")), lambda c: overlaps(placed(c["word"]), f))))
    found = scratch.write(fixed_forms(texts).select("doc_id", "key1", "key2", *KINDS, seeds.alias("seeds")), "personal")
    known = found.select(F.explode(rows_of("seeds")).alias("c"))
    known = known.select(F.xxhash64(_trimmed(F.col("c.word.value"))).alias("value"), F.explode(patterns_of(F.col("c"))).alias("pattern"))
    known = scratch.write(known.groupBy("pattern", "value").agg(F.count("*").alias("n")), "seeds")
    telling = telling_patterns(texts, known, min_seeds, min_share, scratch)

    own = [F.col("doc_id").alias("own"), F.col("key1").alias("own1"), F.col("key2").alias("own2")]
    single = texts.select(*own, F.explode(split_words(F.col("text"))).alias("c"))
    value = _trimmed(F.col("c.word"))
    hits = met(single, telling).select("own", "own1", "own2", "pattern", value.alias("value")).filter("value <> ''")
    hits = scratch.write(hits.withColumn("value", F.xxhash64("value")), "hits")
    edges = hits.select("pattern", "value", F.lit(False).alias("seed")).unionByName(known.select("pattern", "value", F.lit(True).alias("seed")).join(telling, "pattern", "left_semi"))
    edges = scratch.write(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    scores = score_patterns(edges, rounds, scratch)
    strong = scratch.write(scores.filter((F.col("score") >= min_score) & (F.col("n_seeds") >= min_seeds)).select("pattern"), "strong")
    holds = scratch.write(hits.join(strong, "pattern", "left_semi").select("own", "own1", "own2").distinct(), "holds")
    scratch.drop("edges", "seeds", "frequent", "scores", "hits", "telling")

    def same(other: DataFrame) -> Column:
        return F.col("doc_id").eqNullSafe(other["own"]) & (F.col("key1") == other["own1"]) & (F.col("key2") == other["own2"])

    listed = texts.join(holds, same(holds), "left_semi").select("doc_id", "key1", "key2", F.explode(words(F.col("text"))).alias("c"))
    fresh = met(listed, strong).select("doc_id", "key1", "key2", placed(F.col("c.word")).alias("span"))
    added = fresh.filter(F.length("span.value") >= min_length).groupBy("doc_id", "key1", "key2").agg(F.array_sort(F.collect_set("span")).alias("context")).select(*own, "context")
    result = found.join(added, same(added), "left").select("doc_id", *KINDS, let(fixed, lambda f: F.filter(F.coalesce("context", F.array().cast(Pieces)), lambda c: ~overlaps(c, f))).alias("context"))
    result = scratch.write(result, "found")
    scratch.drop("personal", "strong", "holds")
    return result


def span_list(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` by kind, then start, comma-joined."""

    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[of(kind) for kind in kinds]), ",")


def digest(documents: DataFrame) -> DataFrame:
    """``doc_id``, the number of each fixed kind, their digest, and all spans."""
    found = personal_data(documents.select("doc_id", "text"))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_list(KINDS), 256).alias("base_sha256"), span_list((*KINDS, "context")).alias("spans"))


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    """Every document with the personal data of its whole text."""
    return digest(table(spark, sf_dir, "documents"))
