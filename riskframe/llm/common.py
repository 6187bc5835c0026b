"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.sources.shared import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to a table in the shared folder and read from there.

    Cuts the lineage: what follows survives lost executors without computing ``df`` again.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch of texts. Spark's default of 10,000 rows would hold several copies of some 40 MB in each Python process
#: and in the buffers of the JVM, and far more where texts are long.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Lets Spark send texts to Python in batches of ``BATCH_ROWS`` rows, so that memory does not depend on how long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def packed(df: DataFrame) -> DataFrame:
    """All columns of ``df`` in one struct ``row``, so that no name of an extra column can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, *added: str) -> DataFrame:
    """The columns packed in ``row`` and the ``added`` ones; an added one replaces an input column of its name."""
    own = [c for c in df.schema["row"].dataType.names if c not in added]
    return df.select(*[F.col("row").getField(c).alias(c) for c in own], *added)


def whole_text(column: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
