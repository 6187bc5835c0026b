"""Row numbers inside groups that may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_within(
    rows: DataFrame, group: Sequence[str], coarse: Sequence[str], fine: Sequence[str], name: str
) -> DataFrame:
    """``row_number`` over ``group`` ordered by ``coarse`` then ``fine``, without one task per group.

    Rows are numbered inside ``group + coarse`` and shifted by the number of rows in earlier
    coarse groups.  Both steps read the same exchange, and only one count per coarse group ever
    meets in a task.
    """
    keys = [*group, *coarse]
    placed = rows.repartition(*keys)
    before = Window.partitionBy(*group).orderBy(*coarse).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys).orderBy(*fine)
    numbered = placed.withColumn("_inside", F.row_number().over(inside))
    return numbered.join(offsets, keys).withColumn(
        name, (F.col("_before") + F.col("_inside")).cast("int")
    ).drop("_before", "_inside")
