"""Approximate nearest neighbours by a hash-prefix forest.

Each of ``trees`` trees names a vector by a long string of bits, the sides of ``depth`` random hyperplanes, and keeps the strings
sorted. A query descends each tree to the longest prefix that any other vector shares with it. Then it ascends all trees together,
one bit a step, until the vectors that share the prefix number ``candidates`` (over all trees) or the roots are reached; the nearest
of these candidates by exact cosine are the answer.

* The sorted arrays are held in slices: the vectors are dealt at random into slices of ``slice_rows``, each with its part of all
  trees, and a query visits every slice, in blocks of ``query_rows`` queries. What counts is the number of vectors below a prefix,
  and that is the sum over slices, so slicing changes no result and no slice grows with the input.
* Two passes keep what is shuffled small: the first only counts vectors by length of the shared prefix, which gives each query the
  depth at which its ascent ends; the second looks up the vectors at or below that depth and emits the best ``k`` of each slice.
* Equal vectors are one entry that carries its ``k + 1`` smallest ids: a query can use ``k`` of them at most, besides its own.
  So a vector that is stored very often makes no long bucket and loses nothing.

``candidates`` is a share of the index, since vectors without structure have no near neighbours that a smaller share would find.

Vectors that are null, zero, empty, or hold null or non-finite components take no part, nor do rows with a null id, nor vectors whose
length is not ``dim`` (by default the most frequent length, of equally frequent ones the largest). Of several vectors with one id
the smallest counts. A query alone in the index has no result rows.
"""

from __future__ import annotations

import sys
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import empty, table, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES, DEPTH = 20, 32
#: Candidates of a query as a share of the index, counted over all trees.
CANDIDATE_SHARE = 1.0
SLICE_ROWS, QUERY_ROWS = 4_000, 500
SEED = 5

Matrix = np.ndarray


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """``vec_id``, ``vector`` (array of doubles) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).filter("vec_id is not null and vector is not null")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~bad & F.exists("vector", lambda x: x != 0))
    if dim is None:
        sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.col("count").desc(), F.col("dim").desc()).limit(1).collect()
        dim = sizes[0]["dim"] if sizes else 0
    return rows.filter(F.size("vector") == dim).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def entries(rows: DataFrame, ids: int) -> DataFrame:
    """``entry``, ``vector``, ``vec_ids``: distinct vectors with the ``ids`` smallest ids of each, which are cut before the shuffle."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= ids)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("vec_ids")).select(F.monotonically_increasing_id().alias("entry"), "vector", "vec_ids")


def planes(trees: int, depth: int, dim: int, seed: int) -> Matrix:
    return np.random.default_rng(seed).standard_normal((trees * depth, dim))


def hash_strings(vectors: Matrix, trees: int, depth: int, seed: int) -> Matrix:
    """The bits of each vector in each tree, first bit highest, as whole numbers."""
    sides = (vectors @ planes(trees, depth, vectors.shape[1], seed).T > 0).reshape(len(vectors), trees, depth)
    return sides @ (np.int64(1) << np.arange(depth - 1, -1, -1, dtype=np.int64))


def below(strings: Matrix, queries: Matrix, depth: int, at: Matrix) -> tuple[Matrix, Matrix]:
    """Where in the sorted ``strings`` those lie that share the first ``at`` bits with each query."""
    free = np.int64(depth) - at
    low = queries >> free << free
    return np.searchsorted(strings, low), np.searchsorted(strings, low + (np.int64(1) << free), side="left")


def _matrix(column: pa.ChunkedArray) -> Matrix:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def search(vectors: DataFrame, queries: Column, k: int = 5, trees: int = TREES, depth: int = DEPTH, share: float = CANDIDATE_SHARE, slice_rows: int = SLICE_ROWS, query_rows: int = QUERY_ROWS, seed: int = SEED, dim: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other vectors found for each vector that ``queries`` (on ``vec_id``) picks."""
    schema = "query_id long, rank int, vec_id long, score double"
    rows = written(usable(vectors, dim), "vectors")
    index = written(entries(rows, k + 1), "entries")
    asked = written(rows.filter(queries), "queries")
    n, n_queries = index.count(), asked.count()
    if not n or not n_queries:
        return empty(rows.sparkSession, schema)
    # At least so many that distinct ones suffice, as each tree counts a vector once.
    wanted = max(int(np.ceil(share * n)), 2 * (k + 1) * trees)
    slices, blocks = -(-n // slice_rows), -(-n_queries // query_rows)

    # A unit is a slice of the vectors and a block of queries.
    own = F.pmod(F.xxhash64("entry"), F.lit(slices)).cast("int").alias("slice")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    all_blocks, all_slices = (F.explode(F.sequence(F.lit(0), F.lit(x - 1))) for x in (blocks, slices))
    held = index.select("entry", "vector", "vec_ids", own, all_blocks.alias("block"))
    unit = ["slice", "block"]

    def counts(left: pa.Table, right: pa.Table) -> pa.Table:
        """For each query, the vectors of the slice that share at least 0, 1, ... bits with it, over all trees."""
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "n_below": pa.array([], pa.list_(pa.int64()))})
        strings = hash_strings(_matrix(left.column("vector")), trees, depth, seed)
        asked_strings = hash_strings(_matrix(right.column("vector")), trees, depth, seed)
        found = np.zeros((right.num_rows, depth + 1), np.int64)
        for tree in range(trees):
            sorted_strings = np.sort(strings[:, tree])
            for d in range(depth + 1):
                low, high = below(sorted_strings, asked_strings[:, tree], depth, np.int64(d))
                found[:, d] += high - low
        return pa.table({"query_id": right.column("vec_id"), "n_below": pa.array(list(found), pa.list_(pa.int64()))})

    spread = asked.select("vec_id", "vector", block, all_slices.alias("slice"))
    counted = held.groupBy(*unit).cogroup(spread.groupBy(*unit)).applyInArrow(counts, "query_id long, n_below array<long>")
    summed = counted.groupBy("query_id").agg(*[F.sum(F.col("n_below")[d]).alias(f"n{d}") for d in range(depth + 1)])
    # The ascent ends at the greatest depth with enough vectors; the query's own entry is one of them in every tree.
    enough = [F.when(F.col(f"n{d}") >= wanted + trees, F.lit(d)) for d in range(depth, 0, -1)]
    ends = written(summed.select(F.col("query_id").alias("asker"), F.coalesce(*enough, F.lit(0)).cast("long").alias("at")), "ascents")

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        """For each query, the best candidates of the slice, by exact cosines."""
        names = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], t) for c, t in names.items()})
        matrix, asked_matrix = _matrix(left.column("vector")), _matrix(right.column("vector"))
        norms, asked_norms = (np.sqrt((m * m).sum(axis=1)) for m in (matrix, asked_matrix))
        strings, asked_strings = (hash_strings(m, trees, depth, seed) for m in (matrix, asked_matrix))
        ids, queries, at = left.column("vec_ids").to_pylist(), right.column("vec_id").to_pylist(), right.column("at").to_numpy()
        best: list[dict[int, float]] = [{} for _ in queries]
        for tree in range(trees):
            order = np.argsort(strings[:, tree], kind="stable")
            rows = matrix[order] / norms[order, None]
            low, high = below(strings[order, tree], asked_strings[:, tree], depth, at)
            for i, query in enumerate(queries):
                rough = rows[low[i] : high[i]] @ (asked_matrix[i] / asked_norms[i])
                # The own entry may be among the best; what is as near as the last of them stays for the exact order.
                least = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1] if len(rough) > k + 1 else -2.0
                near = order[np.flatnonzero(rough >= least - 1e-9) + low[i]]
                exact = (matrix[near] * asked_matrix[i]).sum(axis=1) / (norms[near] * asked_norms[i])
                for j, score in zip(near.tolist(), exact.tolist(), strict=True):
                    best[i].update((v, score) for v in ids[j] if v != query)
        out = [(query, v, score) for query, found in zip(queries, best, strict=True) for v, score in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]]
        return pa.table({c: pa.array([x[i] for x in out], t) for i, (c, t) in enumerate(names.items())})

    spread = asked.join(ends, F.col("vec_id") == F.col("asker")).select("vec_id", "vector", "at", block, all_slices.alias("slice"))
    found = held.groupBy(*unit).cogroup(spread.groupBy(*unit)).applyInArrow(nearest, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_prefix_forest(spark, sf_dir: str) -> DataFrame:
    """The five nearest other vectors found for every vector whose id is divisible by 50."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
