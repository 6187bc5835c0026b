"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, then exact intersections of sorted arrays.

1. Sizes are cut into bands. A tile holds the sets of one band (its small side) and those of the next band that can still reach
   the similarity with them (its big side), so every pair that can be similar shares a tile.
2. Sets of a tile that are similar differ in at most ``most`` shingles. Each is dealt by hash into ``most + 1 + spare`` parts, so
   at least ``1 + spare`` parts are equal. A tile is split by the content of each part: similar sets meet in some split. Parts of
   fewer than ``least`` shingles take no part, unless a set has more than ``spare`` of these; then all of its parts do. Two
   similar sets with at most ``spare`` such parts in one of them share another part; otherwise both have all their parts dealt.
3. Every split elects a leader, and each member meets the leader; splits that still span several components are compared inside
   tasks, in blocks, across components only: first the nearest ones of each member, then all that are left. Nothing is missed and
   pairs within a component are never listed.
4. A pair is ruled out if the exclusive-or of its bitmaps has more bits than the pair may have differing shingles: each bit takes
   at least one such shingle, so the count bounds the overlap from above. Bitmaps of different widths are folded.
5. Pairs that are left are confirmed by intersecting the sorted shingle arrays, and links give components.

A document's set holds its distinct ``shingle``-word shingles (64-bit hashes); with fewer words the whole sequence is one shingle;
without words (null, empty, blank) the set is empty and linked with nothing. A-Z are lower-cased. Texts of equal words are one set
from the start. Rows with a null ``doc_id`` take part; nulls are larger than all ids when the smallest is named. Rows that repeat
an id carry the same component if they repeat the words. Bitmaps and parts grow with the text, however long. Extra columns are
ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from math import comb, sqrt

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import neardup
from riskframe.llm.common import small_batches, table, whole_text
from riskframe.llm.neardup import Hasher, components
from riskframe.llm.scratch import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(neardup)

#: How much larger than its smallest size the sizes of a band can be.
BAND = 1.5
#: Members of a split that one task compares at most; larger splits are compared in pairs of such blocks.
BLOCK = 20_000
#: Nearest members of other components that are confirmed before all others.
NEAREST = 2


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def largest_partner(n: int, percent: int) -> int:
    return 100 * n // percent


def most_apart(a: int, b: int, percent: int) -> int:
    """Shingles that two linked sets of these sizes can differ in."""
    return (a + b) * (100 - percent) // (100 + percent)


#: What ``tile`` has found; a plain table, as it travels with the code of the tasks.
_TILES: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}


def tile(number: int, percent: int) -> tuple[int, int, int, int, int]:
    """First and last size of the small side, parts, spare parts and least shingles of a part."""
    if (number, percent) not in _TILES:
        _TILES[number, percent] = _tile(number, percent)
    return _TILES[number, percent]


def _tile(number: int, percent: int) -> tuple[int, int, int, int, int]:
    if number == 0:
        first = last = 1
        while most_apart(last + 1, largest_partner(last + 1, percent), percent) == 0:
            last += 1
    else:
        first = tile(number - 1, percent)[1] + 1
        last = max(first, int(first * BAND) - 1)
    most = most_apart(last, largest_partner(last, percent), percent)
    least, spare = (2 if most >= 3 else 1), 0
    while True:
        parts = most + 1 + spare
        few = parts * sum(comb(first, k) * (parts - 1) ** (first - k) / parts**first if first < 200 else _poisson(first / parts, k) for k in range(least))
        if parts == 1 or spare >= most or few + 2 * sqrt(few) <= spare + 0.3:
            return first, last, parts, spare, least
        spare += 1


def _poisson(mean: float, k: int) -> float:
    return float(np.exp(-mean) * mean**k) / (1, 1, 2)[k]


def tiles_of(n: int, percent: int) -> list[tuple[int, bool]]:
    """The tiles of a set of that size, with whether it stands on the small side."""
    number = 0
    while tile(number, percent)[1] < n:
        number += 1
    found = [(number, True)]
    if number and n <= largest_partner(tile(number - 1, percent)[1], percent):
        found.append((number - 1, False))
    return found


def split_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """A key for each part of the sorted set in each of its tiles; the last bit tells the small side (1) from the big side."""
    total = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(_mixed(shingles), out=total[1:])
    high, keys = shingles >> np.uint64(32), []
    for number, small in tiles_of(len(shingles), percent):
        _, _, parts, spare, least = tile(number, percent)
        part = (high * np.uint64(parts)) >> np.uint64(32)  # grows with the hash, so parts are runs of the sorted set
        edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        use = np.diff(edges) >= least
        if parts - use.sum() > spare:
            use[:] = True
        content = (total[edges[1:]] - total[edges[:-1]])[use]
        key = _mixed(content ^ _mixed(np.flatnonzero(use).astype(np.uint64) * np.uint64(64) + np.uint64(number + 1)))
        keys.append((key & ~np.uint64(1)) | np.uint64(small))
    return np.concatenate(keys).view(np.int64)


def bitmap(shingles: np.ndarray) -> bytes:
    """Each shingle flips one of 4 to 8 bits per shingle."""
    width = max(64, 1 << (4 * len(shingles) - 1).bit_length())
    flips = np.bincount((_mixed(shingles * np.uint64(0xA24BAED4963EE407)) & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, octets: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    words = np.frombuffer(bits, np.uint8)
    while len(words) > octets:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def signatures(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``doc_id``, ``key1, key2`` of the row, ``digest`` of the words, ``n_shingles``, ``keys`` and ``bitmap`` of ``doc_id, key1, key2, text``."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shingle)
        for batch in batches:
            digests, sizes, keys, bitmaps = [], [], [], []
            for text in batch.column(3).cast(pa.binary()).to_pylist():
                found = hasher.shingles(text)
                digests.append(hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest())
                sizes.append(len(found))
                keys.append(split_keys(found, percent) if len(found) else [])
                bitmaps.append(bitmap(found) if len(found) else b"")
            added = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bitmaps, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *added], names=["doc_id", "key1", "key2", "digest", "n_shingles", "keys", "bitmap"])

    return rows.mapInArrow(signed, "doc_id long, key1 long, key2 long, digest binary, n_shingles long, keys array<long>, bitmap binary")


def _close(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and bitmaps do not rule out."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n_a, n_b, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                octets = min(len(x), len(y))
                far = percent * max(n_a, n_b) > 100 * min(n_a, n_b) or np.bitwise_count(folded(x, octets) ^ folded(y, octets)).sum() > most_apart(n_a, n_b, percent)
                keep.append(not far)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (reps.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bitmap").alias(f"bitmap_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b").mapInArrow(kept, "a long, b long")


def _confirmed(pairs: DataFrame, reps: DataFrame, rows: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """The written pairs whose sorted shingle arrays have ``100 * intersection >= percent * union``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shingle)
        for batch in batches:
            found = [hasher.shingles(text).tobytes() for text in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["rep", "shingles"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))  # no copy of a whole batch
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    wanted = scratch.write(reps.select("rep", "key1", "key2").join(wanted, "rep"), "wanted")
    texts = rows.select("key1", "key2", "text").join(wanted.hint("shuffle_hash"), ["key1", "key2"])
    # Rows that repeat an id and a text are one again.
    made = texts.select("rep", "text").mapInArrow(sets, "rep long, shingles binary").groupBy("rep").agg(F.any_value("shingles").alias("shingles"))
    made = scratch.write(made, "sets")
    left, right = (made.select(F.col("rep").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    links = scratch.write(both.mapInArrow(linked, "a long, b long"), "confirmed")
    scratch.drop("wanted", "sets")
    return links


def _across(units: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    """Pairs of different components within a split (or two blocks of it) that sizes and bitmaps do not rule out.

    ``nearest``: list only so many for each member, the ones with the fewest different bits.
    """

    def compared(unit: pa.Table) -> pa.RecordBatch:
        unit = unit.sort_by("n_shingles")
        rep, label, side, size, small = (unit.column(c).to_numpy() for c in ("rep", "label", "side", "n_shingles", "small"))
        bitmaps = unit.column("bitmap").to_pylist()
        octets = min(map(len, bitmaps))
        bits = np.stack([folded(b, octets) for b in bitmaps]).view(np.uint64)
        xs, ys = [], []
        right = np.flatnonzero(side != 0)
        for x in np.flatnonzero(side != 1):
            low, high = np.searchsorted(size[right], [-(-percent * size[x] // 100), 100 * size[x] // percent + 1])
            near = right[low:high]
            near = near[(label[near] != label[x]) & (small[near] | small[x]).astype(bool) & ((side[x] == 0) | (nearest is not None) | (rep[near] > rep[x]))]
            if len(near):
                apart = np.bitwise_count(bits[near] ^ bits[x]).sum(axis=1)
                few = apart <= (size[near] + size[x]) * (100 - percent) // (100 + percent)
                near, apart = near[few], apart[few]
                if nearest is not None and len(near) > nearest:
                    near = near[np.argsort(apart, kind="stable")[:nearest]]
                xs.append(np.full(len(near), rep[x]))
                ys.append(rep[near])
        a, b = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (xs, ys))
        return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1)] if batch.num_rows else []
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if held and any(held[0].column(i)[0] != batch.column(i)[start] for i in range(3)):
                    yield compared(pa.concat_tables(held))
                    held = []
                held.append(pa.Table.from_batches([batch.slice(start, end - start)]))
        if held:
            yield compared(pa.concat_tables(held))

    ordered = units.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return ordered.select("bucket", "i", "j", "side", "small", "rep", "label", "n_shingles", "bitmap").mapInArrow(by_unit, "a long, b long").distinct()


def _merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``rep, label`` of all sets after more links."""
    left, right = (labels.select(F.col("rep").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    roots = components(links.join(left, "a").join(right, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")), scratch)
    roots = roots.select(F.col("node").alias("label"), F.col("label").alias("root"))
    merged = scratch.write(labels.join(roots, "label", "left").select("rep", F.coalesce("root", "label").alias("label")), "labels")
    scratch.drop("edges", "confirmed")
    scratch.drop("labels", but_last=True)
    return merged


def jaccard_join(documents: DataFrame, shingle: int, percent: int, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``doc_id, text``; links are pairs of ``percent`` / 100 similarity or more."""
    small_batches(documents.sparkSession)
    scratch = Scratch(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    # Two 64-bit hashes name a row by its id and text, so copies of a text are dealt to different tasks.
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("key2"), "text")
    signed = scratch.write(signatures(rows, shingle, percent), "signatures")
    first = F.min(F.struct("key1", "key2")).alias("k")
    reps = signed.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), first, *[F.any_value(c).alias(c) for c in ("n_shingles", "keys", "bitmap")])
    reps = scratch.write(reps.select("digest", "doc_id", "k.*", "n_shingles", "keys", "bitmap", F.monotonically_increasing_id().alias("rep")), "representatives")

    placed = reps.select("rep", F.explode("keys").alias("key")).select("rep", F.shiftright("key", 1).alias("bucket"), F.col("key").bitwiseAND(F.lit(1)).cast("int").alias("small"))
    buckets = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("small").alias("any"), F.min("rep").alias("leader")).filter("n > 1 and any = 1")
    members = scratch.write(placed.join(buckets.drop("any"), "bucket").filter("rep <> leader"), "members")

    pairs = members.select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = scratch.write(_close(pairs, reps, percent), "pairs")
    labels = _merged(reps.select("rep", F.col("rep").alias("label")), _confirmed(pairs, reps, rows, shingle, percent, scratch), scratch)
    scratch.drop("pairs")
    # Splits of two are settled.
    more = members.filter("n > 2").select("bucket", "rep", "small", "n")
    for nearest in (NEAREST, None):
        labelled = more.join(labels, "rep")
        spanning = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
        apart = labelled.join(spanning, "bucket").join(reps.select("rep", "bitmap", "n_shingles"), "rep")
        apart = apart.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(77)), F.col("blocks")).cast("int"))
        apart = apart.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
        units = apart.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "small", "rep", "label", "n_shingles", "bitmap")
        pairs = scratch.write(_across(units, percent, nearest), "pairs")
        labels = _merged(labels, _confirmed(pairs, reps, rows, shingle, percent, scratch), scratch)
        scratch.drop("pairs")

    named = reps.select("digest", "doc_id", "rep").join(labels, "rep")
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = scratch.write(named.join(smallest, "label").select("digest", "component_id"), "components")
    result = scratch.write(signed.select("doc_id", "digest", "n_shingles").join(named, "digest", "left"), "result")
    scratch.drop("signatures", "representatives", "members", "labels", "components")
    return result.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of 3-word shingles and its component under links of 0.9 or more."""
    return jaccard_join(table(spark, sf_dir, "documents"), shingle=3, percent=90)


OP12_SQL = neardup.OP10_SQL.replace(">= 85 *", ">= 90 *").replace(", doc_id = low AS kept", "")
