"""Tables that are written on the way to a result and dropped as soon as nothing reads them any more."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from riskframe.sources.shared import shared_folder

#: Lets Spark drop the shuffle files of a query when it ends. Written rows do not need them again.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Named tables in the shared folder; each cuts the lineage, so what follows survives lost executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.paths, self.count = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", {}, 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of ``df``, written once and read from there. A table of the same name stays until ``drop`` is called."""
        self.count += 1
        path = f"{self.root}/{name}-{self.count}"
        before = self.spark.conf.get(_CLEAN_UP)
        self.spark.conf.set(_CLEAN_UP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEAN_UP, before)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, but_last: bool = False) -> None:
        """Removes the tables of these names, or all of each name but the one written last."""
        for name in names:
            paths = self.paths.get(name, [])
            kept = paths[-1:] if but_last else []
            for path in paths[: len(paths) - len(kept)]:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
            self.paths[name] = kept
