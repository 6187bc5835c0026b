"""Chat formatting: logs that hold a conversation again and again as it grows are collapsed to the longest before rendering.

1. Turns are placed in each conversation by ``turn`` (null first), then role and text; equal rows count once, null role and text
   as empty. The placing is a range partition by conversation and turn with the counts of earlier parts added, so a conversation
   of any length is spread over many tasks.
2. A rolling hash identifies every prefix: the exclusive-or of the hashes of ``(place, role, text)`` so far, 128 bits wide. It is
   summed within each part and shifted by the parts before, like the places.
3. A conversation whose whole hash is a proper prefix of another's is dropped by an anti-join; of equal ones the one with the
   smallest id stays (null is a conversation of its own, larger than all others). Equal prefixes are aggregated before they meet,
   so a first turn that every conversation shares is one row.
4. The maximal conversations are rendered turn by turn; their turns in order are the text of the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import table, whole_text, written

#: What stands before the role, before the text and after the text.
TEMPLATE = ("<|", "|>\n", "<|end|>\n")


def placed_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, place, role, text, h1, h2``: distinct turns with their place from 1 and the rolling hash of the prefix that they end."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), whole_text("role").alias("role"), whole_text("text").alias("text")).distinct()
    by = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    parts = written(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "turns")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    shifts = counts.select(F.col("conv_id").alias("own"), F.col("part").alias("own_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    same = F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("part") == F.col("own_part"))
    found = parts.withColumn("nth", F.row_number().over(inside)).join(shifts, same).withColumn("place", F.col("nth") + F.col("shift")).drop("own", "own_part")
    # The hash of a turn depends on its place, so the parts are summed once the places are known.
    found = found.withColumn("t1", F.xxhash64("place", "role", "text")).withColumn("t2", F.xxhash64(F.lit(7), "text", "place", "role"))
    found = written(found.select("conv_id", "part", "place", "role", "text", "t1", "t2"), "placed")
    totals = found.groupBy("conv_id", "part").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    shifts = totals.select(F.col("conv_id").alias("own"), F.col("part").alias("own_part"), *[F.coalesce(F.bit_xor(f"x{i}").over(earlier), F.lit(0)).alias(f"s{i}") for i in (1, 2)])
    inside = Window.partitionBy("conv_id", "part").orderBy("place")
    found = found.withColumn("r1", F.bit_xor("t1").over(inside)).withColumn("r2", F.bit_xor("t2").over(inside)).join(shifts, same)
    return found.select("conv_id", "place", "role", "text", F.col("r1").bitwiseXOR(F.col("s1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("s2")).alias("h2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_logged`` of the conversations that stay; ``n_logged``: conversations that equal it."""
    ends = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("place", "h1", "h2"), "place").alias("end"))
    ends = written(ends.select("conv_id", "end.*"), "ends")
    longer = prefixes.join(ends.select(F.col("conv_id").alias("own"), F.col("place").alias("n")), F.col("conv_id").eqNullSafe(F.col("own"))).filter("place < n")
    whole = ends.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    return whole.join(longer.select("place", "h1", "h2").distinct(), ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_logged")


def rendered(role: Column, text: Column, template: tuple[str, str, str] = TEMPLATE) -> Column:
    before, between, after = template
    return F.concat(F.lit(before), role, F.lit(between), text, F.lit(after))


def format_chats(turns: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """``conv_id, n_turns, n_logged, place, rendered`` of every turn of the maximal conversations. An empty table gives no rows."""
    prefixes = written(placed_turns(turns), "prefixes")
    stays = maximal(prefixes).withColumnRenamed("conv_id", "own")
    rows = prefixes.join(stays, F.col("conv_id").eqNullSafe(F.col("own")))
    return rows.select("conv_id", "n_turns", "n_logged", "place", rendered(F.col("role"), F.col("text"), template).alias("rendered"))


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every turn of the maximal conversations, rendered."""
    return format_chats(table(spark, sf_dir, "conversations"))


OP1_SQL = """
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
), prefixes AS (
  SELECT conv_id, role, text, place, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY place) AS prefix
  FROM turns
), whole AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_logged FROM prefixes w
  WHERE place = n_turns AND NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.place = w.n_turns AND p.n_turns > w.n_turns AND p.prefix = w.prefix)
  GROUP BY n_turns, prefix
)
SELECT conv_id, w.n_turns, n_logged, place, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered
FROM whole w JOIN turns USING (conv_id)
"""
