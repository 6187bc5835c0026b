"""Exact deduplication: frequent digests are settled on the map side, all others by an ordinary shuffle.

A Misra-Gries pass of ``counters`` counters per partition names every digest that may hold more than
``2 / (counters + 1)`` of all rows. These candidates (``counters + 1`` at most, whatever the input) are counted exactly, and
their winners are broadcast: rows of a frequent text are settled where they are read. No other text is frequent enough to
burden the task that its rows meet in: those are counted map-side as well, and joined with the one row that their text has become.

Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest
``doc_id`` stays (null ids are smaller than all others); of rows that also share this id exactly one stays.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import packed, small_batches, table, unpacked, whole_text, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNTERS = 1024
_SALTS = 256


def text_digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the UTF-8 text with A-Z lower-cased."""

    def digests(texts: pa.Array) -> pa.Array:
        return pa.array((hashlib.sha256(x.lower()).hexdigest() for x in texts.cast(pa.binary()).to_pylist()), pa.string())

    return F.arrow_udf(digests, "string")(text)


def misra_gries(batches: Iterable[list[str]], counters: int) -> dict[str, int]:
    """At most ``counters`` digests with counts too small by ``rows / (counters + 1)`` at most."""
    held: dict[str, int] = {}
    for batch in batches:
        for digest in batch:
            held[digest] = held.get(digest, 0) + 1
        if len(held) > counters:
            cut = sorted(held.values(), reverse=True)[counters]
            held = {digest: n - cut for digest, n in held.items() if n > cut}
    return held


def heavy_candidates(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``digest`` of every text that may be frequent, ``counters + 1`` rows at most."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0

        def parts() -> Iterator[list[str]]:
            nonlocal rows
            for batch in batches:
                rows += batch.num_rows
                yield batch.column(0).to_pylist()

        held = misra_gries(parts(), counters)
        if rows:
            yield pa.RecordBatch.from_pydict({"digest": [None, *held], "n": [rows, *held.values()]}, pa.schema([("digest", pa.string()), ("n", pa.int64())]))

    merged = written(digests.select("digest").mapInArrow(summaries, "digest string, n long").groupBy("digest").agg(F.sum("n").alias("n")), "summaries")
    total = merged.filter("digest is null").first()
    return merged.filter("digest is not null").filter(F.col("n") * (counters + 1) > (total["n"] if total else 0)).select("digest")


def exact_groups(rows: DataFrame, digests: DataFrame | None = None, counters: int = COUNTERS) -> DataFrame:
    """``rows`` (``doc_id``, ``digest``, any others) with ``keep_id``, ``group_size`` and ``kept``.

    ``digests``: the same ``doc_id`` and ``digest``, if a narrow table of them is at hand. An empty table gives no rows.
    """
    digests = written(rows.select("doc_id", "digest"), "digests") if digests is None else digests
    same = digests.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    groups = same.groupBy("digest").agg(F.sum("n").alias("group_size"), F.max(F.struct("doc_id", "n")).alias("top"))
    groups = groups.select("digest", "group_size", F.col("top.doc_id").alias("keep_id"), F.col("top.n").alias("n_top"))
    winners = written(groups.join(F.broadcast(heavy_candidates(digests, counters)), "digest"), "winners")

    # Rows of a frequent text are settled where they are read; all others meet one aggregated row of their text in a join, which
    # adaptive execution splits for a text that is not quite frequent.
    frequent = F.broadcast(winners.select("digest"))
    named = rows.join(F.broadcast(winners), "digest").unionByName(
        rows.join(frequent, "digest", "left_anti").join(groups.join(frequent, "digest", "left_anti"), "digest")
    )
    is_top = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    names = [*rows.columns, "keep_id", "group_size", "kept"]
    settled = named.filter(~is_top | (F.col("n_top") == 1)).withColumn("kept", is_top).select(names)

    if groups.filter("n_top > 1").isEmpty():
        return settled
    # Rows that share the winning id as well: one of each salt, then one of those. They are written, as they are read twice and the
    # salts must be the same both times.
    salt = F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(_SALTS))
    tied = written(named.filter(is_top & (F.col("n_top") > 1)).withColumn("salt", salt), "tied")
    tied = tied.withColumn("nth", F.row_number().over(Window.partitionBy("digest", "salt").orderBy("doc_id")))
    firsts = tied.filter("nth = 1").withColumn("nth", F.row_number().over(Window.partitionBy("digest").orderBy("salt")))
    tied = firsts.withColumn("kept", F.col("nth") == 1).select(names).unionByName(tied.filter("nth > 1").withColumn("kept", F.lit(False)).select(names))
    return settled.unionByName(tied)


def exact_duplicates(documents: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    small_batches(documents.sparkSession)
    digests = written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(whole_text("text")).alias("digest")), "digests")
    found = exact_groups(digests, digests, counters)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def deduplicate(documents: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns."""
    small_batches(documents.sparkSession)
    rows = packed(documents).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), text_digest(whole_text(F.col("row.text"))).alias("digest"))
    return unpacked(exact_groups(rows, counters=counters).filter("kept"))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the one of its text that stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = """
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(k) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM documents)
WINDOW w AS (PARTITION BY k ORDER BY doc_id DESC NULLS LAST)
"""
