"""Conversation structure repair: turns are aligned to the strings of an alternating grammar, and the cheapest edits are applied.

1. A conversation's rows stand by ``turn`` (null first), then role and text. Each has at most one fault: ``blank`` (nothing but
   blanks), ``duplicate`` (role and text stood earlier) or ``truncated`` (no stop at its end). Rows that repeat in every column
   are counted, not listed: all but the first are duplicates.
2. Repaired role initials must be ``(s?(ua)+)?``. Edits: Keep 0; Rerole to user or assistant 1; Delete 2, forced for blanks and
   duplicates; Insert an empty user or assistant turn 5. A truncated row that is not deleted costs 5 more.
3. Wagner-Fischer: the rows without forced deletes are aligned to the target string of each length, nearest lengths first. The
   best cost so far (deleting all, at first) rules out lengths, and diagonals of each table (Ukkonen's bands). Tables hold the cost
   of what is left, so a trace from the front that takes the least letter gives the ASCII-least audit of a target; targets of
   equal cost are compared by their audits.
4. More than ``SEGMENT`` such rows are aligned segment by segment, between all states that the grammar can be in at a border, and
   the segments are joined by their costs, so time grows with the length and results are the same.

Rows are dealt out by ranges of conversation and turn, so one of any length is spread over tasks for all work on rows and texts.
Only one letter, one number and one count per distinct row meet in the task that aligns a conversation, as its audit is one value.

Null roles and texts are one space; a null ``conv_id`` is a conversation of its own; null turns count in no gap. Texts are never
gathered, however long. Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import small_batches, table, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLANKS = " \t\n\x0b\x0c\r"
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SEGMENT = 64
ROLES = {"u": "user", "a": "assistant"}
#: Grammar states: nothing yet, behind the system turn, behind a user turn, behind an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)

#: One letter per row: its role initial (s, u, a, other) and fault (none, truncated, blank, duplicate).
_LETTERS = "suaoSUAO0123wxyz"
_FORCED = frozenset(_LETTERS[8:])


# --- aligning one conversation ---------------------------------------------------------------------------------------------------


def _target(state: int, system: bool, length: int) -> str:
    rest = "au" if state == USER else "ua"
    return ("s" * system + rest * length)[:length]


def _end(state: int, target: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}[target[-1]] if target else state


def _wagner_fischer(rows: str, target: str, bound: float, closed: bool) -> tuple[float, str] | None:
    """Cost and least audit of rows aligned to the target, or None if it costs more than the bound.

    ``closed``: turns may be inserted behind the last row.
    """
    n, m = len(rows), len(target)

    def least(d: int) -> int:  # cost of any path over the diagonal
        return INSERT * (max(0, d) + max(0, m - n - d)) + DELETE * (max(0, -d) + max(0, d - m + n))

    band = [d for d in range(-n, m + 1) if least(d) <= bound]
    if not band:
        return None
    low, high, far = band[0], band[-1], float("inf")

    def meet(i: int, j: int) -> float:
        row, initial = rows[i], target[j]
        keep = 0 if row.lower() == initial else far if initial == "s" else RELABEL
        return keep + (TRUNCATED if row.isupper() else 0)

    left = [[far] * (m + 1) for _ in range(n + 1)]
    left[n][m] = 0
    for i in range(n, -1, -1):
        own, below = left[i], left[i + 1] if i < n else None
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            best = own[j]
            if below is not None:
                best = min(best, DELETE + below[j])
                if j < m:
                    best = min(best, meet(i, j) + below[j + 1])
            if j < m and target[j] != "s" and (i < n or closed):
                best = min(best, INSERT + own[j + 1])
            own[j] = best
    if left[0][0] > bound or left[0][0] == far:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        here = left[i][j]
        if i < n and here == DELETE + left[i + 1][j]:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and (i < n or closed) and here == INSERT + left[i][j + 1]:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if rows[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return left[0][0], "".join(audit)


#: Segments that are known, as many conversations have the same letters; a plain table, as it travels with the code of the tasks.
_KNOWN: dict[tuple, tuple[float, str, int] | None] = {}
_MOST_KNOWN = 1 << 15


def _segment(rows: str, state: int, ends: tuple[int, ...], closed: bool) -> tuple[float, str, int] | None:
    """Cost, audit and end of the cheapest edits of rows that lead from a grammar state to one of the ends."""
    key = rows, state, ends, closed
    if key not in _KNOWN:
        if len(_KNOWN) >= _MOST_KNOWN:
            _KNOWN.clear()
        _KNOWN[key] = _cheapest(*key)
    return _KNOWN[key]


def _cheapest(rows: str, state: int, ends: tuple[int, ...], closed: bool) -> tuple[float, str, int] | None:
    n, best = len(rows), None
    if state in ends:
        best = (DELETE * n, "D" * n, state)
    lengths = sorted(range(n + DELETE * n // INSERT + 8), key=lambda m: (max(INSERT * (m - n), DELETE * (n - m)), m))
    for length in lengths:
        bound = best[0] if best else float("inf")
        if max(INSERT * (length - n), DELETE * (n - length)) > bound:
            break
        for system in (False, True) if state == START and length else (False,):
            target = _target(state, system, length)
            if _end(state, target) in ends and (found := _wagner_fischer(rows, target, bound, closed)):
                best = min(best or (float("inf"), "", 0), (*found, _end(state, target)))
                bound = best[0]
    return best


def align(rows: str, segment: int = SEGMENT) -> tuple[int, str]:
    """Cost and least audit of rows without forced deletes, as letters of their initials, in upper case if truncated."""
    if len(rows) <= segment:
        return _segment(rows, START, ENDS, True)[:2]
    parts = [rows[at : at + segment] for at in range(0, len(rows), segment)]
    left = [0.0 if state in ENDS else float("inf") for state in range(4)]
    chosen = []
    for number, part in reversed(list(enumerate(parts))):
        last, ways = number == len(parts) - 1, []
        for state in range(4):
            ends = [ENDS] if last else [(end,) for end in range(4)]
            found = [way for end in ends if (way := _segment(part, state, end, last))]
            # No audit of a segment starts another one of it, so the whole is the least if each segment's is.
            ways.append(min(((cost + left[end], audit, end) for cost, audit, end in found), default=(float("inf"), "", state)))
        left = [way[0] for way in ways]
        chosen.append(ways)
    state, audit = START, []
    for ways in reversed(chosen):
        _, own, state = ways[state]
        audit.append(own)
    return int(left[START]), "".join(audit)


def repaired(letters: str, segment: int = SEGMENT) -> tuple[int, str, list[tuple[int | None, str | None]]]:
    """Cost, audit and the repaired turns: place of the row that each is made of (None: inserted) and its new role (None: its own)."""
    live = [at for at, letter in enumerate(letters) if letter not in _FORCED]
    cost, edits = align("".join(letters[at] for at in live), segment)
    audit, turns, nth, at, waiting = [], [], 0, 0, 0
    initials = iter(())
    first = next((k for k, e in enumerate(edits) if e in "KRI"), None)
    if first is not None:
        row = live[edits[:first].count("D")] if edits[first] == "K" else None
        system = row is not None and letters[row] in "sS"
        initials = iter(_target(START, system, len(edits)))
    for edit in edits:
        if edit == "I":
            waiting += 1
            continue
        audit.append("D" * (live[nth] - at) + "I" * waiting + edit)
        turns += [(None, ROLES[next(initials)]) for _ in range(waiting)]
        if edit != "D":
            initial = next(initials)
            turns.append((live[nth], None if edit == "K" else ROLES[initial]))
        at, nth, waiting = live[nth] + 1, nth + 1, 0
    audit.append("D" * (len(letters) - at) + "I" * waiting)
    turns += [(None, ROLES[next(initials)]) for _ in range(waiting)]
    return cost + DELETE * (len(letters) - len(live)), "".join(audit), turns


# --- Spark -----------------------------------------------------------------------------------------------------------------------


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def listed_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies, letter, part, nth``: distinct rows, with the letter of the first copy and their place."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *spaced, copies.cast("long").alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    # A text that a conversation repeats at very many turns is one row here, and its rows are a skewed side that the join can split.
    names = [F.xxhash64("role", "text").alias("key1"), F.xxhash64(F.lit(1), "text", "role").alias("key2")]
    rows = rows.select("*", *names)
    first = rows.groupBy("conv_id", "key1", "key2").agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull(), "turn")).getField("turn").alias("first"))
    first = first.filter("n > 1").select(F.col("conv_id").alias("own"), F.col("key1").alias("own1"), F.col("key2").alias("own2"), "first")
    rows = rows.join(first, _same("conv_id", "own") & (F.col("key1") == F.col("own1")) & (F.col("key2") == F.col("own2")), "left")
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(end == "", 2).when(F.col("own1").isNotNull() & ~_same("turn", "first"), 3).when(end.isin(".", "!", "?"), 0).otherwise(1)
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = rows.select("conv_id", "turn", "role", "text", "copies", F.substring(F.lit(_LETTERS), 4 * fault + kind + 1, F.lit(1)).alias("letter"))
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.left("text", F.lit(64))]
    rows = written(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "turns")
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return written(rows.withColumn("nth", F.row_number().over(inside)), "listed")


def aligned(listed: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, blank, duplicate, truncated, illegal, cost, audit`` and ``turns``: ``part, nth, role`` of the repaired turns in order."""
    legal = {"su", "ua", "au"}
    schema = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<part:int,nth:int,role:string>>"
    fields = pa.schema([(n, pa.int64()) for n in ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("turns", pa.list_(pa.struct([("part", pa.int32()), ("nth", pa.int32()), ("role", pa.string())])))])

    def one(conv_id: int | None, chunks: list[dict]) -> dict:
        letters, places = [], []
        for chunk in chunks:
            for row in chunk["rows"]:
                letter = row["letter"]
                again = letter if letter in _LETTERS[8:12] else _LETTERS[12 + _LETTERS.index(letter) % 4]
                letters.append(letter + again * (row["copies"] - 1))
                places += [(chunk["part"], row["nth"])] + [(None, None)] * (row["copies"] - 1)
        letters = "".join(letters)
        cost, audit, turns = repaired(letters, segment)
        initials = ["suao"[_LETTERS.index(x) % 4] for x in letters]
        counts = {"blank": _LETTERS[8:12], "duplicate": _LETTERS[12:], "truncated": _LETTERS[4:8]}
        return {
            "conv_id": conv_id, "cost": cost, "audit": audit,
            **{name: sum(x in among for x in letters) for name, among in counts.items()},
            "illegal": sum(a + b not in legal for a, b in zip(initials, initials[1:], strict=False)),
            "turns": [dict(zip(("part", "nth"), places[at] if at is not None else (None, None), strict=True), role=role) for at, role in turns],
        }

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(row["conv_id"], row["chunks"]) for row in batch.to_pylist()], fields)

    chunks = listed.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("nth", "letter", "copies"))).alias("rows"))
    chunks = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "rows"))).alias("chunks"))
    return written(chunks.mapInArrow(all_of, schema), "aligned")


def repair(turns: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Audits, one row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``; and the repaired
    turns: ``conv_id, place`` (from 1)``, role, text``.

    A column ``copies`` of the turns, if there is one, says how often each row stands.
    """
    small_batches(turns.sparkSession)
    listed = listed_turns(turns)
    found = aligned(listed, segment)
    gaps = listed.groupBy(F.col("conv_id").alias("own")).agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    audits = found.join(gaps, _same("conv_id", "own")).select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    made = found.select("conv_id", F.posexplode("turns").alias("at", "made")).select(F.col("conv_id").alias("own"), (F.col("at") + 1).alias("place"), F.col("made.part").alias("own_part"), F.col("made.nth").alias("own_nth"), F.col("made.role").alias("new"))
    same = _same("conv_id", "own") & (F.col("part") == F.col("own_part")) & (F.col("nth") == F.col("own_nth"))
    rows = made.join(listed.select("conv_id", "part", "nth", "role", "text"), same, "left")
    return audits, rows.select(F.col("own").alias("conv_id"), "place", F.coalesce("new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def hashed(turns: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of the lines ``role:text`` of each conversation; a batch of turns is held at a time."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            done = []
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                line = f"{role}:{text}".encode()
                if state is not None and conv_id == own:
                    state.update(b"\n" + line)
                else:
                    done += [(own, state.hexdigest())] if state is not None else []
                    own, state = conv_id, hashlib.sha256(line)
            yield of(done)
        if state is not None:
            yield of([(own, state.hexdigest())])

    def of(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "sha256"])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.select("conv_id", "role", "text").mapInArrow(digests, "conv_id long, sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults: ``crc32`` of ``conv_id:turn`` modulo 20 drops, empties, cuts, repeats or reassigns a row."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(number("conv_id"), F.lit(":"), number("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), code.alias("code")).filter("code <> 0")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("code") == 3, 2).otherwise(1).alias("copies"),
    )


def op13_structure_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired: its faults, the cheapest edits and a digest of the repaired turns.

    Null columns of a row count as one space, also in the hashed ``conv_id:turn``.
    """
    turns = table(spark, sf_dir, "conversations")
    audits, made = repair(damaged(turns))
    original = turns.select(F.col("conv_id").cast("long").alias("original")).distinct()
    digests = hashed(made).withColumnRenamed("conv_id", "hashed")
    rows = original.join(audits, _same("original", "conv_id"), "left").join(digests, _same("original", "hashed"), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return rows.select(F.col("original").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"))
