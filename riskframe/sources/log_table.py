"""A keyed table that batches change: a base snapshot, delta batches, and a pointer to the base that counts.

    <path>/delta/<batch>/     changed rows of one batch; a batch that runs again overwrites its own folder
    <path>/base/<batch>/      all rows after the batches up to that one
    <path>/CURRENT            the number of the base that counts, replaced in one step

Readers take the base that the pointer names and the complete deltas behind it. Merging deltas into a new base changes nothing that
a reader sees until the pointer is replaced, so a crash at any step, or a step that runs twice, leaves the same table. Folders that
no reader needs are removed one merge later, so a reader that started before a merge still finds its files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Deltas that a reader merges at most before they go into a new base.
MOST_DELTAS = 8


class _Files:
    """The few file operations that a table needs, in the file system of its path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.system = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def complete(self, folder: str) -> list[int]:
        """Numbers of the sub-folders that a job has committed."""
        if not self.system.exists(self.at(folder)):
            return []
        names = [status.getPath().getName() for status in self.system.listStatus(self.at(folder))]
        return sorted(int(n) for n in names if n.isdigit() and self.system.exists(self.at(f"{folder}/{n}/_SUCCESS")))

    def read(self, name: str) -> str | None:
        if not self.system.exists(self.at(name)):
            return None
        stream = self.system.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Writes the text beside the file and renames it over it, which is one step."""
        stream = self.system.create(self.at(f"{name}.new"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at("").toUri(), self.conf).rename(self.at(f"{name}.new"), self.at(name), options)

    def remove(self, name: str) -> None:
        self.system.delete(self.at(name), True)


class LogTable:
    """Rows by ``keys``; of several rows with a key the one of the latest batch counts."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str | T.StructType, most_deltas: int = MOST_DELTAS) -> None:
        self.spark, self.path, self.keys, self.most = spark, path.rstrip("/"), list(keys), most_deltas
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.files = _Files(spark, path)

    def base(self) -> int | None:
        """The batch that the current base goes up to."""
        text = self.files.read("CURRENT")
        return None if text is None else int(text)

    def deltas(self) -> list[int]:
        """Complete batches that are not in the base."""
        base = self.base()
        return [b for b in self.files.complete("delta") if base is None or b > base]

    def write(self, rows: DataFrame, batch: int) -> None:
        """Stores a batch (one row per key) and merges when there are too many. A batch that is in the base already is left as it is."""
        base = self.base()
        if base is None or batch > base:
            rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/delta/{batch}")
        if len(self.deltas()) > self.most:
            self.compact()

    def _rows(self, folder: str, batch: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}/{batch}").withColumn("_batch", F.lit(batch).cast("long"))

    def _merged(self, base: int | None, deltas: list[int]) -> DataFrame:
        parts = ([] if base is None else [self._rows("base", base)]) + [self._rows("delta", b) for b in deltas]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        values = [c for c in self.schema.fieldNames() if c not in self.keys]
        latest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "_batch").alias("v"))
        return latest.select(*[F.col(c) if c in self.keys else F.col(f"v.{c}").alias(c) for c in self.schema.fieldNames()])

    def read(self) -> DataFrame:
        """The current rows: the base and at most as many deltas as a writer leaves."""
        return self._merged(self.base(), self.deltas())

    def compact(self) -> None:
        """Merges all complete deltas into a new base."""
        base, deltas = self.base(), self.deltas()
        if not deltas:
            return
        self._merged(base, deltas).write.mode("overwrite").parquet(f"{self.path}/base/{deltas[-1]}")
        self.files.replace("CURRENT", str(deltas[-1]))
        # What the base before held is needed by nobody who starts now; its own files stay for those who read them.
        for old in self.files.complete("delta"):
            if base is not None and old <= base:
                self.files.remove(f"delta/{old}")
        for old in self.files.complete("base"):
            if base is not None and old < base:
                self.files.remove(f"base/{old}")

