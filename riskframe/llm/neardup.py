"""Near-duplicate documents: MinHash bands name candidates, odd sketches and the full shingle sets confirm them.

1. One pass over the texts gives each document its number of shingles, a digest of its words, ``bands`` of MinHash values and an
   odd sketch: one-permutation MinHash samples folded into a bitmap by parity. The exclusive-or of two sketches has few bits
   where the samples agree, so its population count estimates high similarities well.
2. Equal texts collapse to one representative; everything below is done on representatives.
3. Every bucket of a band (representatives with equal band values) elects a leader, and each member is held against it, so a
   large group costs rows in proportion to its size. Pairs that the sketches do not rule out are confirmed on full sets.
4. Confirmed links give components. Members of buckets that still span several components are compared inside tasks, sketch
   against sketch and block by block, but only across components. First each member's nearest one is confirmed and merged. Then
   the sets travel along: every pair that is left is confirmed where it is found unless links join it already, so a task returns
   fewer links than it has members. No link that shares a bucket is lost, and pairs within a component are never listed.

A pair shares no bucket with a probability below 1e-6: 24 bands of 5 at a similarity of 0.85, 30 bands of 4 at 0.8.

A document's set holds its distinct ``shingle``-word shingles (64-bit hashes); with fewer words the whole sequence is one shingle;
without words (null, empty, blank) the set is empty and linked with nothing. A-Z are lower-cased. Rows with a null ``doc_id``
take part like others; nulls are larger than all ids when the smallest is named.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import packed, small_batches, table, unpacked, whole_text
from riskframe.llm.scratch import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: MinHash values for the bands.
SAMPLES = 120
#: Bins of the one-permutation MinHash that the sketch folds, and bits of the sketch.
BINS, SKETCH_BITS = 4096, 2048
#: Standard deviations that a pair may fall short by before the sketches rule it out.
SLACK = 4.5
#: Members of a bucket that one task compares at most by sketches, and by full sets; larger buckets are compared in pairs of such
#: blocks.
BLOCK, SET_BLOCK = 20_000, 4_000

_RNG = np.random.default_rng(20240601)
_BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_MULTIPLY = _RNG.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 2**63, SAMPLES, dtype=np.uint64)
_BAND = _RNG.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Distinct shingle hashes of texts, by arithmetic on whole byte arrays."""

    def __init__(self, shingle: int) -> None:
        self.shingle = shingle
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers), 1 << 16)
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), dtype=np.uint64)
            self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE_INVERSE)]), dtype=np.uint64)

    def words(self, text: bytes) -> np.ndarray:
        """A 64-bit hash per word, words being runs of bytes other than space and 0x09-0x0D, A-Z lower-cased."""
        raw = np.frombuffer(text.lower(), np.uint8)
        if not len(raw):
            return np.empty(0, np.uint64)
        inside = (raw != 32) & ((raw < 9) | (raw > 13))
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            return np.empty(0, np.uint64)
        self._grow(len(raw) + 1)
        terms = np.where(inside, _BYTES[raw] * self.powers[: len(raw)], np.uint64(0))
        return _mixed(np.add.reduceat(terms, starts) * self.inverses[starts] + (ends - starts).astype(np.uint64))

    def shingles(self, text: bytes) -> np.ndarray:
        """The distinct shingle hashes, sorted."""
        words, k = self.words(text), self.shingle
        if not len(words):
            return words
        k = min(k, len(words))
        joined = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            joined = (joined + words[i : len(words) - k + 1 + i]) * np.uint64(0xD6E8FEB86659FD93)
            joined ^= joined >> np.uint64(32)
        return np.unique(_mixed(joined + np.uint64(k)))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of the hash functions."""
    lows = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[None, at : at + 2048] * _MULTIPLY[:, None] + _ADD[:, None]
        np.minimum(lows, part.min(axis=1), out=lows)
    return lows


def odd_sketch(shingles: np.ndarray) -> bytes:
    """The smallest value of each bin that the sorted set touches flips one bit; equal samples of two sets cancel in the exclusive-or."""
    _, first = np.unique(shingles & np.uint64(BINS - 1), return_index=True)
    at = _mixed(shingles[first] * np.uint64(0xA24BAED4963EE407)) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def most_bits(n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """Bits in the exclusive-or of two sketches beyond which a pair of that similarity is all but impossible.

    At that similarity ``(1 - s) / (1 + s)`` of the two sizes together lie in one set alone. Such a shingle shows if it is the
    smallest of its bin; it then flips one bit, and a second one if the other set has a sample in that bin. Of ``f`` flips
    ``bits / 2 * (1 - exp(-2 f / bits))`` bits are left on average. Small sets are sampled nearly whole, so they vary little.
    """
    apart = (1 - similarity) / (1 + similarity) * (n_a + n_b)
    low, high = np.minimum(n_a, n_b) / BINS, np.maximum(n_a, n_b) / BINS
    shown = -np.expm1(-low) / low
    flips = apart * shown * (2 - high * np.exp(-high) / -np.expm1(-high))
    left = SKETCH_BITS / 2 * -np.expm1(-2 * flips / SKETCH_BITS)
    spread = 2 * flips * (1 - shown) + np.minimum(2 * flips * flips / SKETCH_BITS, SKETCH_BITS / 4) + 1
    return left + SLACK * np.sqrt(spread)


def text_keys(text: Column) -> list[Column]:
    """Two 64-bit hashes that name a text."""
    return [F.xxhash64(text).alias("key1"), F.xxhash64(F.lit(1), text).alias("key2")]


def signatures(rows: DataFrame, shingle: int, rows_in_band: int) -> DataFrame:
    """``doc_id``, ``key1, key2``, ``digest`` of the words, ``n_shingles``, ``bands`` and ``sketch`` of every row of ``doc_id, key1, key2, text``."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, number = Hasher(shingle), _mixed(np.arange(1, SAMPLES // rows_in_band + 1, dtype=np.uint64))
        for batch in batches:
            digests, sizes, bands, sketches = [], [], [], []
            for text in batch.column(3).cast(pa.binary()).to_pylist():
                found = hasher.shingles(text)
                digests.append(hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest())
                sizes.append(len(found))
                if len(found):
                    lows = min_hashes(found)
                    key = _mixed(lows * _BAND).reshape(-1, rows_in_band).sum(axis=1, dtype=np.uint64)
                    bands.append(_mixed(key ^ number).view(np.int64))
                    sketches.append(odd_sketch(found))
                else:
                    bands.append([])
                    sketches.append(b"")
            added = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *added], names=["doc_id", "key1", "key2", "digest", "n_shingles", "bands", "sketch"])

    return rows.mapInArrow(signed, "doc_id long, key1 long, key2 long, digest binary, n_shingles long, bands array<long>, sketch binary")


def _full_sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``rep``, ``shingles`` (sorted 64-bit hashes) of the representatives in ``wanted`` (``rep, own, key1, key2``), from their texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shingle)
        for batch in batches:
            found = [hasher.shingles(text).tobytes() for text in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["rep", "shingles"])

    # A representative is one row of its text, named by id and text, so copies of a text are dealt to different tasks. Rows that
    # repeat both are one again where their hashes are kept.
    chosen = rows.join(wanted.hint("shuffle_hash"), (rows["key1"] == wanted["key1"]) & (rows["key2"] == wanted["key2"]) & rows["doc_id"].eqNullSafe(wanted["own"]))
    return chosen.select("rep", "text").mapInArrow(sets, "rep long, shingles binary").groupBy("rep").agg(F.any_value("shingles").alias("shingles"))


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)


def _close(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The pairs that sizes and sketches do not rule out."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(i).to_numpy() for i in (2, 3))
            bits = np.bitwise_count(_sketches(batch.column(4)) ^ _sketches(batch.column(5))).sum(axis=1)
            keep = (np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b) - 1e-6) & (bits <= most_bits(n_a, n_b, similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    left, right = (reps.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(kept, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have ``100 * intersection >= percent * union``."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))  # no copy of a whole batch
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(linked, "a long, b long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``node``, ``label``: the smallest node that ``a, b`` links reach, for every node that has a link.

    Alternating star contraction: each round hangs the larger neighbours, then all smaller ones, on the smallest; the edges stay
    as many as the nodes and are written each round. A node with very many neighbours is only ever aggregated, never gathered.
    """
    scratch = scratch or Scratch(links.sparkSession)
    edges = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = scratch.write(both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        edges = scratch.write(small.filter("u <> v").distinct(), "edges")
        scratch.drop("large")
        scratch.drop("edges", but_last=True)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _near(size: np.ndarray, label: np.ndarray, side: np.ndarray, sketch: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member of a unit sorted by size: the members of other components that sizes and sketches allow, and their bits."""
    right = np.flatnonzero(side != 0)
    for x in np.flatnonzero(side != 1):
        low, high = np.searchsorted(size[right], [similarity * size[x] - 1e-6, size[x] / similarity + 1e-6])
        near = right[low:high]
        near = near[label[near] != label[x]]
        if len(near):
            bits = np.bitwise_count(sketch[near] ^ sketch[x]).sum(axis=1)
            few = bits <= most_bits(size[near], size[x], similarity)
            if few.any():
                yield x, near[few], bits[few]


def _nearest(unit: pa.Table, percent: int) -> list[tuple[int, int]]:
    """The nearest member of another component of each member."""
    rep, label, side, size = (unit.column(c).to_numpy() for c in ("rep", "label", "side", "n_shingles"))
    pairs = {tuple(sorted((int(rep[x]), int(rep[near[bits.argmin()]])))) for x, near, bits in _near(size, label, side, _sketches(unit.column("sketch")), percent / 100)}
    return sorted(pairs)


def _forest(unit: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that join the components of a unit as far as its pairs do, fewer than its members."""
    rep, label, side, size = (unit.column(c).to_numpy() for c in ("rep", "label", "side", "n_shingles"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in unit.column("shingles")]
    links, parts = [], label.copy()
    for x, near, _ in _near(size, label, side, _sketches(unit.column("sketch")), percent / 100):
        near = near[(parts[near] != parts[x]) & ((side[x] == 0) | (near > x))]
        for at in range(0, len(near), 64):
            some = near[at : at + 64]
            some = some[parts[some] != parts[x]]
            if not len(some):
                continue
            held = np.concatenate([sets[y] for y in some])
            place = np.minimum(np.searchsorted(sets[x], held), size[x] - 1)
            both = np.add.reduceat((sets[x][place] == held).astype(np.int64), np.cumsum(size[some]) - size[some])
            for y in some[100 * both >= percent * (size[some] + size[x] - both)]:
                if parts[y] != parts[x]:
                    links.append((int(min(rep[x], rep[y])), int(max(rep[x], rep[y]))))
                    parts[parts == parts[y]] = parts[x]
    return links


def _by_unit(units: DataFrame, compared: Callable[[pa.Table, int], list[tuple[int, int]]], percent: int) -> DataFrame:
    """The pairs ``a, b`` of each unit: a bucket, or two blocks of it. One unit is held at a time."""

    def pairs(held: list[pa.Table]) -> pa.RecordBatch:
        found = compared(pa.concat_tables(held).sort_by("n_shingles"), percent)
        return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1)] if batch.num_rows else []
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if held and any(held[0].column(i)[0] != batch.column(i)[start] for i in range(3)):
                    yield pairs(held)
                    held = []
                held.append(pa.Table.from_batches([batch.slice(start, end - start)]))
        if held:
            yield pairs(held)

    return units.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(by_unit, "a long, b long").distinct()


def _units(members: DataFrame, labels: DataFrame, reps: DataFrame, block: int) -> DataFrame:
    """``bucket, i, j, side, rep, label, n_shingles, sketch`` of the members of buckets that span components, in blocks."""
    labelled = members.join(labels, "rep")
    spanning = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
    apart = labelled.join(spanning, "bucket").join(reps.select("rep", "sketch", "n_shingles"), "rep")
    apart = apart.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(77)), F.col("blocks")).cast("int"))
    apart = apart.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return apart.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "rep", "label", "n_shingles", "sketch")


def _merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``rep, label`` of all representatives after more links."""
    left, right = (labels.select(F.col("rep").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    roots = components(links.join(left, "a").join(right, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")), scratch)
    roots = roots.select(F.col("node").alias("label"), F.col("label").alias("root"))
    merged = scratch.write(labels.join(roots, "label", "left").select("rep", F.coalesce("root", "label").alias("label")), "labels")
    scratch.drop("edges", "confirmed", "pairs")
    scratch.drop("labels", but_last=True)
    return merged


def near_duplicates(rows: DataFrame, shingle: int, percent: int, rows_in_band: int = 5, block: int = BLOCK) -> DataFrame:
    """``doc_id, key1, key2, digest, n_shingles, component_id, kept`` of every row of ``doc_id, text``, linked at ``percent`` / 100 similarity or more.

    ``key1, key2`` are hashes of the text, ``digest`` is one of its words. ``kept``: the document whose id names its component. Rows
    that repeat an id and a text all carry the same result.
    """
    small_batches(rows.sparkSession)
    scratch = Scratch(rows.sparkSession)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(whole_text("text")), whole_text("text").alias("text"))
    signed = scratch.write(signatures(rows, shingle, rows_in_band), "signatures")
    row = F.min(F.struct("key1", "key2", F.col("doc_id").alias("own"))).alias("row")
    reps = signed.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), row, *[F.any_value(c).alias(c) for c in ("n_shingles", "bands", "sketch")])
    reps = scratch.write(reps.withColumn("rep", F.monotonically_increasing_id()), "representatives")

    placed = reps.select("rep", F.explode("bands").alias("bucket"))
    buckets = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("rep", F.xxhash64("rep")).alias("leader")).filter("n > 1")
    members = scratch.write(placed.join(buckets, "bucket"), "members")
    wanted = scratch.write(reps.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "row.*"), "wanted")
    sets = scratch.write(_full_sets(rows, wanted, shingle), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return scratch.write(_confirmed(scratch.write(pairs, "pairs"), sets, percent), "confirmed")

    pairs = members.filter("rep <> leader").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    labels = _merged(reps.select("rep", F.col("rep").alias("label")), confirmed(_close(pairs, reps, percent / 100)), scratch)
    labels = _merged(labels, confirmed(_by_unit(_units(members, labels, reps, block), _nearest, percent)), scratch)
    units = _units(members, labels, reps, min(block, SET_BLOCK)).join(sets, "rep")
    units = units.select("bucket", "i", "j", "side", "rep", "label", "n_shingles", "sketch", "shingles")
    labels = _merged(labels, scratch.write(_by_unit(units, _forest, percent), "confirmed"), scratch)
    scratch.drop("sets", "wanted", "members")

    named = reps.select("digest", "doc_id", "rep").join(labels, "rep")
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = scratch.write(named.join(smallest, "label").select("digest", "component_id"), "components")
    result = signed.select("doc_id", "key1", "key2", "digest", "n_shingles").join(named, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    result = result.select("doc_id", "key1", "key2", "digest", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    result = scratch.write(result, "result")
    scratch.drop("signatures", "representatives", "labels", "components")
    return result


def deduplicate(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each component, with all their columns; documents without words stay.

    Of rows that repeat the id and the words of the one that stays, one stays.
    """
    found = near_duplicates(documents.select("doc_id", "text"), shingle, percent, rows_in_band=4).filter("kept and n_shingles > 0")
    # Rows that share the id and the words of the one that stays: one text of them, and one row of that text.
    texts = found.groupBy("doc_id", "digest", "key1", "key2").agg(F.count("*").alias("n_same")).groupBy("doc_id", "digest")
    stays = texts.agg(F.min(F.struct("key1", "key2", "n_same")).alias("s")).select(F.col("doc_id").alias("own"), F.col("s.key1").alias("own1"), F.col("s.key2").alias("own2"), "s.n_same")
    rows = packed(documents).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), *text_keys(whole_text(F.col("row.text"))))
    empty = rows.filter(~whole_text(F.col("row.text")).rlike(r"[^\x20\x09-\x0D]")).select("row")
    rows = rows.join(stays, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("key1") == F.col("own1")) & (F.col("key2") == F.col("own2")))
    repeated = rows.filter("n_same > 1").groupBy("own", "own1", "own2").agg(F.any_value("row").alias("row")).select("row")
    return unpacked(rows.filter("n_same = 1").select("row").unionByName(repeated).unionByName(empty))


def op10_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its component under links of 0.85 or more on sets of 3-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS m, any_value(b.n) AS n
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM common WHERE 100 * k >= 85 * (m + n - k) UNION ALL SELECT b, a FROM common WHERE 100 * k >= 85 * (m + n - k)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, low AS component_id, doc_id = low AS kept
FROM sets JOIN (SELECT a, min(b) AS low FROM reached GROUP BY a) ON a = doc_id
"""
