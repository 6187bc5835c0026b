"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks. DataFrame functions only.

1. Sizes are words. The targets share ``epochs`` times all words by weight; a target stops at ``most`` times its source's size and
   the excess is shared again by weight until none is above.
2. All words asked for make ``H`` blocks of ``block`` words. Sources get blocks by the highest quotients ``target / (2 k + 1)``.
   Each source's documents lie in shards (by a hash of the document), and its blocks go to its shards the same way, by their sizes.
3. A shard lines its documents up in a seeded random order and cuts the line into blocks. A quota above the number of blocks takes
   whole passes first; the rest is a run of neighbouring blocks from a seeded place on, around the end if need be. As the order is
   random this is a random choice of documents, and only those at the ends of the run are cut.

Sources are ranked without gathering them: they are range-partitioned, ranked within each partition and shifted by the counts of the
partitions before. A source of any size is only ever aggregated or split into shards. Documents with equal id and text lie next to
each other in any order, which changes nothing. A source of no words takes nothing; an empty table gives no rows. Null text has 0
words; null is a source like any other, ranked last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import packed, table, unpacked, whole_text, written

WEIGHTS = (5, 2, 1)
EPOCHS, MOST = 1.5, 2
#: Words of a block, documents of a shard.
BLOCK, SHARD_DOCS = 16, 5_000
SEED = 11

_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD)).cast("long")


def _number(digest: Column) -> Column:
    """48 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 50, 12), 16, 10).cast("long")


def ranked(df: DataFrame, by: list[Column], name: str, *sums: str) -> DataFrame:
    """``df`` with ``rank`` from 0 in the order of ``by``, and ``before_<c>``: the sum of each column of ``sums`` over earlier rows.

    Range partitions are ranked on their own and shifted by what lies before them; no task sees more than one of them.
    """
    parts = written(df.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), name)
    totals = parts.groupBy("part").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in sums])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    shifts = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"), *[F.coalesce(F.sum(f"sum_{c}").over(earlier), F.lit(0)).alias(f"shift_{c}") for c in sums])
    inside = Window.partitionBy("part").orderBy(*by)
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    found = parts.withColumn("nth", F.row_number().over(inside) - 1)
    for c in sums:
        found = found.withColumn(f"so_far_{c}", F.coalesce(F.sum(c).over(so_far), F.lit(0)))
    found = found.join(F.broadcast(shifts), "part").withColumn("rank", F.col("nth") + F.col("shift"))
    for c in sums:
        found = found.withColumn(f"before_{c}", F.col(f"so_far_{c}") + F.col(f"shift_{c}"))
    return found.select(*df.columns, "rank", *[f"before_{c}" for c in sums])


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, most: float = MOST) -> DataFrame:
    """``source, source_size, rank, target`` for every source of ``source, source_size``.

    Each round caps the sources that the present level lifts above their bound; the level of the others rises. It stops when a
    round caps none.
    """
    placed = ranked(sizes, [F.col("source").asc_nulls_last()], "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    placed = written(placed.withColumn("weight", weight).withColumn("bound", F.col("source_size") * float(most)), "weights")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, left = 0.0, float(epochs * total)
    while True:
        capped = F.col("bound") <= F.col("weight") * level
        row = placed.agg(F.sum(F.when(capped, F.col("bound"))).alias("capped"), F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        raised = (left - (row["capped"] or 0.0)) / row["open"]
        if raised <= level:
            break
        level = raised
    return placed.select("source", "source_size", "rank", F.least("bound", F.col("weight") * level).alias("target"))


def source_quotas(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """``goals`` (``source, target, rank``) with ``quota``: its blocks, by the highest quotients; ties go to the first source.

    The last divisor lies so close to the block size that no quota is further from ``target / block`` than ``slack``; only the
    quotients within that distance are ranked. They are a few for each source on average, whatever the number of sources.
    """
    all_ = goals.agg(F.count("*").alias("n"), F.sum(F.col("target").cast("decimal(38,6)")).alias("total")).first()
    n, total = all_["n"], float(all_["total"] or 0)
    seats = round(total / block)
    slack = F.ceil(F.col("target") / float(total or 1) * n).cast("long") + 2
    middle = F.floor(F.col("target") / block).cast("long")
    near = goals.withColumn("low", F.greatest(middle - slack, F.lit(0))).withColumn("high", F.when(F.col("target") > 0, middle + slack).otherwise(0))
    given = near.agg(F.sum("low")).first()[0] or 0
    offers = near.filter("high > low").select("source", F.explode(F.expr("sequence(low, high - 1)")).alias("k"), "target", F.col("rank").alias("nth_source"))
    offers = offers.select("source", "nth_source", (F.col("target") / (2 * F.col("k") + 1)).alias("quotient"))
    won = ranked(offers, [F.col("quotient").desc(), F.col("nth_source")], "quotients").filter(F.col("rank") < seats - given)
    won = won.groupBy(F.col("nth_source").alias("rank")).agg(F.count("*").alias("more"))
    return near.join(won, "rank", "left").select(*goals.columns, (F.col("low") + F.coalesce("more", F.lit(0))).alias("quota"))


def shard_quotas(shards: DataFrame) -> DataFrame:
    """``shards`` (``nth_source, shard, shard_size, quota`` of the source) with ``shard_quota``, by the highest quotients.

    A source has one shard for so many documents, so its window holds a row for each of those.
    """
    source = Window.partitionBy("nth_source")
    ideal = F.when(F.col("source_words") > 0, F.col("quota") * F.col("shard_size") / F.col("source_words")).otherwise(0.0)
    found = shards.withColumn("source_words", F.sum("shard_size").over(source)).withColumn("n", F.count("*").over(source)).withColumn("ideal", ideal)
    slack = F.ceil(F.col("n") * F.col("shard_size") / F.greatest("source_words", F.lit(1))).cast("long") + 2
    found = found.withColumn("low", F.greatest(F.floor("ideal").cast("long") - slack, F.lit(0))).withColumn("given", F.sum("low").over(source))
    high = F.when(F.col("shard_size") > 0, F.floor("ideal").cast("long") + slack).otherwise(0)
    offers = found.withColumn("high", high).filter("high > low").withColumn("k", F.explode(F.expr("sequence(low, high - 1)")))
    offers = offers.withColumn("nth", F.row_number().over(source.orderBy((F.col("shard_size") / (2 * F.col("k") + 1)).desc(), "shard")))
    won = offers.filter(F.col("nth") <= F.col("quota") - F.col("given")).groupBy("nth_source", "shard").agg(F.count("*").alias("more"))
    return found.join(won, ["nth_source", "shard"], "left").select(*shards.columns, (F.col("low") + F.coalesce("more", F.lit(0))).alias("shard_quota"))


def mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, most: int = MOST, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """``rows`` (``doc_id, source, size``, any others) with ``source_size, target``, ``copies`` (whole passes that take the document),
    ``from_word`` and ``until_word`` (what the last pass takes of it besides; equal if nothing), ``until_word2`` (words from its
    start that a run around the end takes as well) and ``taken``."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    sizes = written(sizes, "sizes")
    goals = targets(sizes.select("source", "source_size"), weights, epochs, most)
    goals = written(source_quotas(goals, block), "quotas").withColumnRenamed("rank", "nth_source")
    goals = goals.join(sizes.select(F.col("source").alias("own"), "source_docs"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    goals = goals.withColumnRenamed("source", "name").withColumn("n_shards", F.ceil(F.col("source_docs") / shard_docs).cast("long"))
    place = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size")), 256)
    dealt = rows.join(goals, F.col("source").eqNullSafe(F.col("name"))).withColumn("place", place)
    dealt = dealt.withColumn("shard", F.pmod(_number(F.col("place")), F.col("n_shards")))
    shards = dealt.groupBy("nth_source", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
    shards = written(shard_quotas(shards), "shards").drop("quota")
    line = Window.partitionBy("nth_source", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = dealt.withColumn("until", F.sum("size").over(line)).withColumn("since", F.col("until") - F.col("size"))
    lined = lined.join(shards, ["nth_source", "shard"])
    blocks = F.greatest(F.ceil(F.col("shard_size") / block).cast("long"), F.lit(1))
    lined = lined.withColumn("blocks", blocks).withColumn("asked", F.least("shard_quota", F.col("blocks") * most))
    lined = lined.withColumn("copies", F.floor(F.col("asked") / F.col("blocks")).cast("long")).withColumn("more", F.col("asked") % F.col("blocks"))
    first = F.pmod(_number(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit("start"), F.col("nth_source"), F.col("shard")), 256)), F.col("blocks")) * block
    lined = lined.withColumn("first", first).withColumn("last", F.col("first") + F.col("more") * block)
    # The run covers [first, last) of the line, and [0, around) when it passes the end.
    inside = lambda x: F.greatest(F.least(x, F.col("until")) - F.col("since"), F.lit(0))
    around = F.greatest(F.col("last") - F.col("blocks") * block, F.lit(0))
    lined = lined.withColumn("from_word", inside(F.col("first"))).withColumn("until_word", F.greatest(inside(F.col("last")), F.col("from_word"))).withColumn("until_word2", inside(around))
    taken = F.col("copies") * F.col("size") + F.col("until_word") - F.col("from_word") + F.col("until_word2")
    return lined.select(*rows.columns, "source_size", "target", "copies", "from_word", "until_word", "until_word2", taken.alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    return F.coalesce(F.regexp_substr(text, F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), n.cast("string"), F.lit("}+"))), F.lit(""))


def words_between(text: Column, start: Column, end: Column) -> Column:
    """The text from its word ``start`` (from 0) to before its word ``end``."""
    upto = F.when(end > 0, first_words(text, end)).otherwise("")
    return F.regexp_replace(F.when(start > 0, F.substr(upto, F.length(first_words(text, start)) + 1)).otherwise(upto), r"^[\x20\x09-\x0D]+", "")


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns: whole ones as often as the mix takes them, and the excerpts at the ends of
    each shard's run (``n_chars``, if there is such a column, follows the excerpt)."""
    rows = packed(documents).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), n_words(whole_text(F.col("row.text"))).alias("size"))
    found = mix(rows, **options)
    parts = F.filter(F.array(F.struct(F.col("from_word").alias("a"), F.col("until_word").alias("b")), F.struct(F.lit(0).cast("long").alias("a"), F.col("until_word2").alias("b"))), lambda p: p["b"] > p["a"])
    whole = F.transform(F.array_repeat(F.lit(0), F.col("copies").cast("int")), lambda x: F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b")))
    out = found.select("row", "size", F.explode(F.concat(whole, parts)).alias("part"))
    cut = (F.col("part.b") - F.col("part.a")) < F.col("size")
    text = F.when(cut, words_between(whole_text(F.col("row.text")), F.col("part.a"), F.col("part.b"))).otherwise(F.col("row.text"))
    out = out.withColumn("text", text)
    added = ["text"]
    if "n_chars" in documents.columns:
        out, added = out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("row.n_chars")).cast(documents.schema["n_chars"].dataType)), ["text", "n_chars"]
    return unpacked(out, *added).select(*[F.col(f"`{c}`") for c in documents.columns])


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    documents = table(spark, sf_dir, "documents")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(whole_text("text")).alias("size"))
    return mix(written(rows, "words")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT *, [5.0, 2.0, 1.0][nth % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS bound FROM (
    SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sized GROUP BY source)
), levels AS (  -- the level if this source and all that fill up before it are capped
  SELECT nth, bound / weight AS full_at, (SELECT 1.5::DOUBLE * sum(source_size) FROM sources) AS asked,
    coalesce(sum(bound) OVER w, 0.0) AS capped, (SELECT sum(weight) FROM sources) - coalesce(sum(weight) OVER w, 0.0) AS open
  FROM sources WINDOW w AS (ORDER BY bound / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT s.*, least(bound, weight * coalesce((SELECT max((asked - capped) / open) FROM levels WHERE (asked - capped) / open <= full_at), 1e300)) AS target FROM sources s
), seats AS (
  SELECT nth, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, nth) AS place
  FROM (SELECT nth, target, unnest(range(0, floor(target / 16)::BIGINT + (SELECT count(*) FROM sources) + 2)) AS k FROM goals WHERE target > 0)
), quotas AS (
  SELECT g.*, ceil(docs / 5000.0)::BIGINT AS n_shards,
    (SELECT count(*) FROM seats WHERE seats.nth = g.nth AND place <= (SELECT round(sum(target) / 16) FROM goals)) AS quota
  FROM goals g
), dealt AS (
  SELECT d.*, q.source_size, q.target, q.quota, q.nth, h AS place,
    list_sum(list_transform(range(12), lambda i: (strpos('0123456789abcdef', substr(h, 50 + i, 1)) - 1) * (1::BIGINT << (4 * (11 - i)))))::BIGINT % q.n_shards AS shard
  FROM (SELECT *, sha256('11|' || coalesce(doc_id::VARCHAR, '') || '|' || size) AS h FROM sized) d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source
), shards AS (SELECT nth, shard, sum(size)::BIGINT AS shard_size, any_value(quota) AS quota FROM dealt GROUP BY nth, shard),
shard_seats AS (
  SELECT nth, shard, row_number() OVER (PARTITION BY nth ORDER BY shard_size / (2 * k + 1) DESC, shard) <= quota AS won
  FROM (SELECT *, unnest(range(0, quota)) AS k FROM shards WHERE shard_size > 0)
), asked AS (
  SELECT s.nth, s.shard, s.shard_size, greatest(ceil(s.shard_size / 16.0)::BIGINT, 1) AS blocks, coalesce(q.n, 0) AS shard_quota,
    sha256('11|start|' || s.nth || '|' || s.shard) AS h
  FROM shards s LEFT JOIN (SELECT nth, shard, count(*) FILTER (WHERE won) AS n FROM shard_seats GROUP BY nth, shard) q USING (nth, shard)
), runs AS (
  SELECT *, least(shard_quota, blocks * 2) // blocks AS copies, least(shard_quota, blocks * 2) % blocks AS more,
    list_sum(list_transform(range(12), lambda i: (strpos('0123456789abcdef', substr(h, 50 + i, 1)) - 1) * (1::BIGINT << (4 * (11 - i)))))::BIGINT % blocks * 16 AS first
  FROM asked
), lined AS (
  SELECT d.*, sum(size) OVER (PARTITION BY d.nth, d.shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS until,
    copies, first, first + more * 16 AS last, greatest(first + more * 16 - blocks * 16, 0) AS around
  FROM dealt d JOIN runs r ON d.nth = r.nth AND d.shard = r.shard
)
SELECT doc_id, size, source_size, target,
  (copies * size + greatest(greatest(least(last, until) - (until - size), 0) - greatest(least(first, until) - (until - size), 0), 0)
    + greatest(least(around, until) - (until - size), 0))::BIGINT AS taken
FROM lined
"""
