"""Lines, excluded blocks and enclosing functions of files that are stored in parts (operators P1-P3, W2).

A file of any size is a table of parts ``file_id, part_no, content``, cut anywhere, even inside a line or a line break. No task
holds a file, and text moves only where a line crosses parts. What a part needs to know of those before it is a scan over one
narrow row per part:

* lines: the number of line breaks before the part;
* functions: the last ``def`` before a block of lines;
* excluded blocks: open blocks and brace depths. The depth is a counter that decides where a block ends, so parts have no
  transition function of fixed size. Instead the lines that can change the state, as a few numbers each, pass through one task per
  file in order; the task holds the state and nothing else. Files without a block marker send nothing there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.functions.columns import rows_of, strip
from riskframe.functions.text import LINE_BREAK, strip_line_literals
from riskframe.operators.detect import function_name

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Lines that share a row of a scan.
LINE_BLOCK = 1 << 14


def cut(files: DataFrame, size: int) -> DataFrame:
    """Parts of ``size`` characters of a file table ``file_id, content``."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("content") - 1, F.lit(0)), F.lit(size))
    return files.select("file_id", "content", F.posexplode(rows_of(starts)).alias("part_no", "at")).select(
        "file_id", "part_no", F.substring("content", F.col("at") + 1, F.lit(size)).alias("content")
    )


def _earlier_parts() -> Window:
    return Window.partitionBy("file_id").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)


def line_rows(parts: DataFrame) -> DataFrame:
    """``file_id, line_no, line`` of every line (operator P1), as if the file were one text.

    A line belongs to the part that holds its break, the last one to the last part. What stands of it in earlier parts - the text
    behind the last break of one part, and parts without a break - is gathered line by line and put in front.
    """
    end = F.nullif(F.right("content", F.lit(1)), F.lit(""))
    narrow = parts.select("file_id", "part_no", end.alias("end"), F.startswith("content", F.lit("\n")).alias("joined"))
    joins = F.col("joined") & F.coalesce(F.last("end", ignorenulls=True).over(_earlier_parts()) == "\r", F.lit(False))
    joining = narrow.select("file_id", "part_no", joins.alias("joins"))
    own = F.when(F.col("joins"), F.expr("substring(content, 2)")).otherwise(F.col("content"))
    pieces = parts.join(joining, ["file_id", "part_no"]).select("file_id", "part_no", F.split(own, LINE_BREAK, -1).alias("pieces"))

    broken = (F.size("pieces") > 1).cast("int")
    known = pieces.select("file_id", "part_no", (F.size("pieces") - 1).alias("breaks"), broken.alias("broken"), F.element_at("pieces", -1).alias("tail"))
    known = known.select(
        "file_id", "part_no", "breaks", "tail", F.coalesce(F.sum("breaks").over(_earlier_parts()), F.lit(0)).alias("before"),
        F.coalesce(F.sum("broken").over(_earlier_parts()), F.lit(0)).alias("line"), F.col("broken"),
        F.lead("part_no").over(Window.partitionBy("file_id").orderBy("part_no")).isNull().alias("last"),
    )
    # The open text behind the same number of parts with breaks is one line.
    held = known.select("file_id", "part_no", "tail", (F.col("line") + F.col("broken")).alias("line"))
    opened = held.groupBy("file_id", "line").agg(F.array_sort(F.collect_list(F.struct("part_no", "tail"))).alias("held"))
    opened = opened.select("file_id", "line", F.array_join(F.transform("held", lambda h: h["tail"]), "").alias("open"))
    heads = known.filter("broken = 1").select("file_id", "part_no", "line").join(opened, ["file_id", "line"], "left").select("file_id", "part_no", F.col("open").alias("head"))
    ends = known.filter("last").select("file_id", "part_no", (F.col("line") + F.col("broken")).alias("line")).join(opened, ["file_id", "line"]).select("file_id", "part_no", F.col("open").alias("end"))

    keys = ["file_id", "part_no"]
    rows = pieces.join(known.select(*keys, "before"), keys).join(heads, keys, "left").join(ends, keys, "left")
    closed = F.transform(F.slice("pieces", F.lit(1), F.size("pieces") - 1), lambda t, i: F.when(i == 0, F.concat(F.coalesce("head", F.lit("")), t)).otherwise(t))
    # A text that ends with a break has no line behind it.
    found = F.when(F.col("end") != "", F.concat(closed, F.array("end"))).otherwise(closed)
    return rows.select("file_id", "before", F.posexplode(rows_of(found)).alias("i", "line")).select(
        "file_id", (F.col("before") + F.col("i") + 1).cast("int").alias("line_no"), "line"
    )


def code_rows(lines: DataFrame) -> DataFrame:
    """``line`` rows with ``code``, lower-cased and free of literals (operator P3, line by line)."""
    return lines.withColumn("code", strip_line_literals(F.lower("line")))


class BlockState:
    """Open blocks of a file: a bit each, the brace depth of the lowest one, and the depth inside an excluded function."""

    def __init__(self, closers: Sequence[int | None]) -> None:
        self.closers, self.balanced = closers, sum(1 << b for b, c in enumerate(closers) if c is None)
        self.open = self.depth = self.function = 0

    def keeps(self, delta: int, opens: int, starts: bool, closes: int) -> bool:
        """Whether the next line counts; ``closes``: bits of the closing texts that it equals."""
        if self.function > 0 or (starts and delta > 0):
            self.function = max(0, self.function + delta)
            return False
        if opens:
            self.open |= opens
            if opens & self.balanced:
                self.depth = delta
            return False
        if not self.open:
            return True
        claimed = self.open & -self.open
        if claimed & self.balanced:
            done, self.depth = self.depth + delta <= 0, max(0, self.depth + delta)
        else:
            done = bool(closes & claimed)
        self.open -= claimed if done else 0
        return False

    @property
    def outside(self) -> bool:
        return not self.open and self.function <= 0

    @property
    def ends_next(self) -> bool:
        """Whether any next line ends a block, as its braces are balanced already."""
        return self.function <= 0 and bool(self.open & -self.open & self.balanced) and self.depth <= 0


class _Walk:
    """The runs of excluded lines, from the lines that change the state, file by file in order."""

    def __init__(self, closers: Sequence[int | None]) -> None:
        self.closers, self.file, self.done = closers, None, []
        self.state, self.first, self.at = BlockState(closers), None, 0

    def taken(self) -> list[tuple]:
        done, self.done = self.done, []
        return done

    def line(self, file_id, line_no: int, *facts) -> None:
        """The next line with facts; lines between it and the one before change no brace and open nothing."""
        while self.state.ends_next and (file_id != self.file or self.at + 1 < line_no):
            self._step(self.at + 1, 0, 0, False, 0)
        if file_id != self.file:
            if self.first is not None:
                self.done.append((self.file, self.first, None))
            self.file, self.state, self.first = file_id, BlockState(self.closers), None
        self._step(line_no, *facts)

    def _step(self, line_no: int, *facts) -> None:
        self.at = line_no
        if not self.state.keeps(*facts) and self.first is None:
            self.first = line_no
        if self.first is not None and self.state.outside:
            self.done.append((self.file, self.first, line_no))
            self.first = None


def excluded_ranges(
    lines: DataFrame, blocks: Sequence[tuple] = tuple(rules.EXCLUDED_BLOCKS), functions: Sequence[str] = tuple(rules.EXCLUDED_FUNCTIONS)
) -> DataFrame:
    """``file_id, first, last``: runs of lines inside excluded blocks."""
    closers = [None if closing is None else b for b, (_, _, closing) in enumerate(blocks)]

    def count(of: str) -> Column:
        return F.length("line") - F.length(F.replace("line", F.lit(of), F.lit("")))

    # Nearly no line holds one of the texts, and only those that do are trimmed and looked at.
    bare = strip(F.col("line"))

    def holds(text: str) -> Column:
        return F.contains("line", F.lit(text))

    opens = F.lit(0)
    for bit, (start, also, _) in reversed(list(enumerate(blocks))):
        opens = F.when(holds(start) & holds(also) & F.startswith(bare, F.lit(start)) & F.contains(bare, F.lit(also)), 1 << bit).otherwise(opens)
    closes = F.lit(0)
    for bit, (_, _, closing) in enumerate(blocks):
        for text in dict.fromkeys(closing or []):
            closes = closes + F.when(holds(text) & (bare == text), 1 << bit).otherwise(0)
    named = F.lit(False)
    for name in functions:
        named = named | (holds(f"function {name}(") & F.startswith(bare, F.lit(f"function {name}(")))
    facts = lines.select(
        "file_id", "line_no", (count("{") - count("}")).alias("delta"), opens.alias("opens"), named.alias("starts"), closes.alias("closes")
    )
    marked = facts.filter("opens > 0 or starts").select("file_id").distinct()
    events = facts.filter("opens > 0 or starts or closes > 0 or delta <> 0").join(marked, "file_id", "left_semi")
    kind = events.schema["file_id"].dataType.simpleString()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(closers)
        for batch in batches:
            for file_id, *facts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                walk.line(file_id, *facts)
            kind = batch.schema.field("file_id").type
            yield of(walk.taken(), kind)
        walk.line(None, 0, 0, 0, False, 0)
        if left := walk.taken():
            yield of(left, kind)

    def of(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array([d[0] for d in done], kind), *(pa.array([d[i] for d in done], pa.int32()) for i in (1, 2))]
        return pa.RecordBatch.from_arrays(columns, names=["file_id", "first", "last"])

    # By a digest of the key: by the key itself Spark drops this step where the join before it is hashed alike, and then lets adaptive
    # execution read that join's partitions in pieces, so a file's lines would come to several tasks.
    ordered = events.repartition(F.xxhash64("file_id")).sortWithinPartitions("file_id", "line_no")
    return ordered.select("file_id", "line_no", "delta", "opens", "starts", "closes").mapInArrow(runs, f"file_id {kind}, first int, last int")


def _block(line_no: Column) -> Column:
    return F.floor(line_no / LINE_BLOCK).cast("int")


def scannable_rows(lines: DataFrame, **blocks: Sequence) -> DataFrame:
    """``file_id, line_no, line`` outside the excluded blocks (operator P2)."""
    ranges = excluded_ranges(lines, **blocks)
    ends = lines.groupBy("file_id").agg(F.max("line_no").alias("end"))
    # A run meets the blocks of lines that it touches, so the join has an equal key and no pairs beyond a block.
    spans = ranges.join(ends, "file_id").select("file_id", "first", F.coalesce("last", "end").alias("last"))
    spans = spans.withColumn("block", F.explode(F.sequence(_block(F.col("first")), _block(F.col("last")))))
    inside = (F.col("line_no") >= F.col("first")) & (F.col("line_no") <= F.col("last"))
    left, right = lines.withColumn("block", _block(F.col("line_no"))).alias("l"), spans.alias("r")
    same = (F.col("l.file_id") == F.col("r.file_id")) & (F.col("l.block") == F.col("r.block"))
    return left.join(right, same & inside, "left_anti").select("file_id", "line_no", "line")


def function_rows(lines: DataFrame) -> DataFrame:
    """``file_id, line_no, function``: the last ``def`` at or before each line, else an empty text (operator W2).

    A scan in two levels: the last ``def`` of each block of lines is carried to the next ones, one narrow row a block, and the
    lines of a block start from what is carried.
    """
    named = lines.select("file_id", "line_no", _block(F.col("line_no")).alias("block"), F.nullif(function_name(F.col("line")), F.lit("")).alias("name"))
    summary = named.groupBy("file_id", "block").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("line_no"))).alias("name"))
    earlier = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select("file_id", "block", F.last("name", ignorenulls=True).over(earlier).alias("carried"))
    own = F.last("name", ignorenulls=True).over(Window.partitionBy("file_id", "block").orderBy("line_no"))
    rows = named.withColumn("own", own).join(carried, ["file_id", "block"])
    return rows.select("file_id", "line_no", F.coalesce("own", "carried", F.lit("")).alias("function"))
