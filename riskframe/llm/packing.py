"""Packing by a grouping genetic algorithm: pieces of documents into as few sequences of ``capacity`` tokens as it can.

1. Documents are tokenised where they are read; only lengths and checksums leave that pass. Documents longer than a sequence are
   cut so that all pieces but the first fill a sequence; those need no packing.
2. The other pieces are dealt at random into shards of about ``shard_items`` pieces. A shard is one problem for the algorithm, and
   several islands work on it independently: each evolves its own population of complete packings. A crossover injects whole
   well-filled bins of one parent into the other, removes the bins that then hold a piece twice, exchanges displaced pieces for
   shorter ones where that fills a bin, and puts the rest into the fullest bins that take them. A mutation empties the worst
   bins instead.
3. After each round the islands of a shard pass their best packing to their neighbour. After the last round the best packing of
   the shard stays, and its badly filled bins are opened: their pieces are dealt into shards again and packed once more.

Null texts are empty; every document ends with id 0, so each has at least one piece. Rows that repeat an id are packed as they are.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import small_batches, table, whole_text, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY, END_ID = 2048, 0
SHARD_ITEMS = 4_000
ISLANDS, ROUNDS, POPULATION, GENERATIONS = 2, 2, 4, 4
#: A bin of the first packing with more free tokens than this share of a sequence is opened and packed again.
LOOSE = 0.02

Packing = list[list[int]]


# --- tokens -----------------------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of the byte-level BPE vocabulary, as ``tokenizers`` gives them.

    Plain texts (letters below U+0250 and common punctuation) go through ``tiktoken`` with the same vocabulary and pattern, which
    gives the same ids several times as fast; texts with any other character or a special token's name go through ``tokenizers``.
    """

    def __init__(self, vocabulary: str, ranks: str) -> None:
        import base64
        import re

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        with open(public_tokenizers.path(ranks), "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.fast = fast._core_bpe
        self.odd = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]|<\\|endoftext\\||[^ ]{1000}|\\s{1000}")

    def ids(self, text: str) -> np.ndarray:
        if self.odd.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(self.fast.encode_to_tiktoken_buffer(text, set()), np.uint32).astype("<u4", copy=False)


def pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, ranks)
        for batch in batches:
            doc, number, starts, lengths, sums = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encoder.ids(text), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % capacity or capacity
                at = [0, *range(first, len(ids), capacity), len(ids)]
                for n, (start, end) in enumerate(zip(at, at[1:], strict=False)):
                    doc.append(row)
                    number.append(n)
                    starts.append(start)
                    lengths.append(end - start)
                    sums.append(zlib.crc32(ids[start:end].tobytes()))
            columns = [batch.column(0).take(pa.array(doc, pa.int64())), *(pa.array(x, t) for x, t in ((number, pa.int32()), (starts, pa.int64()), (lengths, pa.int64()), (sums, pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the algorithm on one shard ---------------------------------------------------------------------------------------------


def best_fit(lengths: list[int], items: list[int], bins: Packing, capacity: int) -> Packing:
    """Puts each item into the fullest bin that takes it, longest first; opens bins where none does. Changes ``bins``."""
    room = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for item in sorted(items, key=lambda i: -lengths[i]):
        at = bisect_left(room, (lengths[item], -1))
        if at < len(room):
            free, k = room.pop(at)
            bins[k].append(item)
        else:
            free, k = capacity, len(bins)
            bins.append([item])
        if free > lengths[item]:
            insort(room, (free - lengths[item], k))
    return bins


def swapped(lengths: list[int], items: list[int], bins: Packing, capacity: int) -> list[int]:
    """Fills bins by exchanging one of their items for a longer one of ``items`` that just fits; the items left over are shorter."""
    spare = sorted((lengths[i], i) for i in items)
    for b in bins:
        free = capacity - sum(lengths[i] for i in b)
        for place, item in enumerate(b):
            if not free or not spare:
                break
            at = bisect_left(spare, (lengths[item] + free + 1, -1)) - 1
            if at >= 0 and spare[at][0] > lengths[item]:
                length, b[place] = spare.pop(at)
                insort(spare, (lengths[item], item))
                free -= length - lengths[item]
    return [i for _, i in spare]


def fitness(lengths: list[int], packing: Packing, capacity: int) -> tuple[int, float]:
    """Few bins, then many full ones; smaller is better."""
    return len(packing), -sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in packing)


def _injected(lengths: list[int], giver: Packing, taker: Packing, capacity: int, rng: np.random.Generator) -> Packing:
    """The taker with whole bins of the giver: those well filled ones that some random choice picks."""
    filled = [b for b in giver if sum(lengths[i] for i in b) >= 0.995 * capacity]
    chosen = [filled[k] for k in np.flatnonzero(rng.random(len(filled)) < rng.uniform(0.2, 0.6))]
    taken = {i for b in chosen for i in b}
    kept, displaced = [list(b) for b in chosen], []
    for b in taker:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    return best_fit(lengths, swapped(lengths, displaced, kept, capacity), kept, capacity)


def _shaken(lengths: list[int], packing: Packing, capacity: int, rng: np.random.Generator) -> Packing:
    """The packing with its emptiest bins and a few others opened and packed again."""
    order = sorted(range(len(packing)), key=lambda k: sum(lengths[i] for i in packing[k]))
    opened = set(order[: max(2, len(order) // 50)]) | set(rng.choice(len(packing), max(1, len(packing) // 20)).tolist())
    displaced = [i for k in opened for i in packing[k]]
    kept = [list(b) for k, b in enumerate(packing) if k not in opened]
    return best_fit(lengths, swapped(lengths, displaced, kept, capacity), kept, capacity)


def evolve(lengths: list[int], seeds: list[Packing], seed: int, capacity: int = CAPACITY, population: int = POPULATION, generations: int = GENERATIONS) -> Packing:
    """The best packing that an island finds; ``seeds`` are elites from before."""
    rng = np.random.default_rng(seed)
    low = -(-sum(lengths) // capacity)
    first = seeds or [best_fit(lengths, list(range(len(lengths))), [], capacity)]
    ranked = sorted(((fitness(lengths, p, capacity), p) for p in first), key=lambda x: x[0])
    while len(ranked) < population and ranked[0][0][0] > low:
        child = _shaken(lengths, ranked[0][1], capacity, rng)
        ranked.append((fitness(lengths, child, capacity), child))
    for _ in range(generations):
        ranked.sort(key=lambda x: x[0])
        if ranked[0][0][0] <= low:  # as few as the tokens need
            break
        for _ in range(population // 2):
            x, y = rng.choice(len(ranked), 2, replace=False)
            child = _injected(lengths, ranked[min(x, y)][1], ranked[max(x, y)][1], capacity, rng)
            if rng.random() < 0.5:
                child = _shaken(lengths, child, capacity, rng)
            ranked.append((fitness(lengths, child, capacity), child))
        ranked = sorted(ranked, key=lambda x: x[0])[:population]
    return min(ranked, key=lambda x: x[0])[1]


# --- islands ----------------------------------------------------------------------------------------------------------------


def _bins_of(assigned: list[int]) -> Packing:
    bins: dict[int, list[int]] = {}
    for item, k in enumerate(assigned):
        bins.setdefault(k, []).append(item)
    return list(bins.values())


def pack(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """``uid, shard, bin, length, used`` for ``items`` (``uid`` unique, ``length`` at most ``capacity``); ``used``: tokens of the bin."""
    shards = items.agg(F.ceil(F.count("*") / shard_items)).first()[0] or 1
    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(shards)).alias("shard"))
    problems = written(dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items")), "shards")

    def island(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for shard, number, turn, lengths, elites in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                packing = evolve(lengths, [_bins_of(e) for e in elites], seed + 7919 * shard + 104729 * number + 31 * turn, capacity)
                assigned = np.zeros(len(lengths), np.int64)
                for k, b in enumerate(packing):
                    assigned[b] = k
                best.append((assigned, *fitness(lengths, packing, capacity)))
            columns = [batch.column(0), batch.column(1), pa.array([b[0] for b in best], pa.list_(pa.int64())), pa.array([b[1] for b in best], pa.int64()), pa.array([b[2] for b in best], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "island", "elite", "n_bins", "spread"])

    # A shard is one row of little size and much work, so the number of tasks follows the shards, not the bytes.
    units = shards * islands
    tasks = min(units, max(items.sparkSession.sparkContext.defaultParallelism, units // 16))
    everywhere = problems.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.length").alias("lengths"))
    elites = None
    for turn in range(rounds):
        if elites is None:
            work = everywhere.withColumn("elites", F.array().cast("array<array<bigint>>"))
        else:  # its own elite and its neighbour's
            sent = elites.select("shard", "island", "elite").unionByName(elites.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "elite"))
            work = everywhere.join(sent.groupBy("shard", "island").agg(F.collect_list("elite").alias("elites")), ["shard", "island"])
        work = work.select("shard", "island", F.lit(turn).alias("turn"), "lengths", "elites").repartition(tasks, "shard", "island")
        elites = written(work.mapInArrow(island, "shard long, island int, elite array<long>, n_bins long, spread double"), "elites")
    best = elites.groupBy("shard").agg(F.min_by("elite", F.struct("n_bins", "spread", "island")).alias("elite"))
    placed = problems.join(best, "shard").select("shard", F.explode(F.arrays_zip("items", "elite")).alias("x"))
    placed = placed.select("shard", F.col("x.items.uid").alias("uid"), F.col("x.items.length").alias("length"), F.col("x.elite").alias("bin"))
    used = placed.groupBy("shard", "bin").agg(F.sum("length").alias("used"))
    return placed.join(used, ["shard", "bin"]).select("uid", "shard", "bin", "length", "used")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece. An empty table gives no rows."""
    from pyspark.sql import Window

    small_batches(documents.sparkSession)
    cut = written(pieces(documents, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    first = written(pack(cut.filter(F.col("length") < capacity), capacity, shard_items), "packed")
    tight = F.col("used") >= (1 - LOOSE) * capacity
    again = written(pack(first.filter(~tight), capacity, shard_items, seed=2), "packed")
    numbered = [df.select("uid", (F.col("shard") * (1 << 24) + F.col("bin")).alias("number"), F.lit(kind).alias("kind")) for kind, df in ((0, first.filter(tight)), (1, again))]
    full = cut.filter(F.col("length") == capacity).select("uid", F.col("uid").alias("number"), F.lit(2).alias("kind"))
    placed = cut.join(numbered[0].unionByName(numbered[1]).unionByName(full), "uid")
    place = Window.partitionBy("kind", "number").orderBy("uid")
    offset = F.sum("length").over(place) - F.col("length")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") * 4 + F.col("kind")).alias("sequence_id"), offset.alias("offset"))


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack_documents(table(spark, sf_dir, "documents"))
