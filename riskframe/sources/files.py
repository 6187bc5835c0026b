"""File tables (operators S1-S3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.functions.columns import lookup
from riskframe.functions.paths import is_code_file, is_manifest, manifest_type


# The byte sequences of one character in UTF-8, as the standard's table of well-formed sequences has them.
_UTF8 = "|".join([
    r"[\x00-\x7f]", r"[\xc2-\xdf][\x80-\xbf]", r"\xe0[\xa0-\xbf][\x80-\xbf]",
    r"[\xe1-\xec\xee\xef][\x80-\xbf]{2}", r"\xed[\x80-\x9f][\x80-\xbf]", r"\xf0[\x90-\xbf][\x80-\xbf]{2}",
    r"[\xf1-\xf3][\x80-\xbf]{3}", r"\xf4[\x80-\x8f][\x80-\xbf]{2}",
])


def spread(rows: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    """Deal rows out to ``partitions`` tasks, if a number is given.

    Scanning is bound by CPU, so an input of few splits would leave the cluster idle; the caller
    who knows that its input is such asks for it.  Nothing is shuffled otherwise.
    """
    return rows if partitions is None else rows.repartition(partitions, *keys)


def read_file_table(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """A table of files: ``repo, path, file_ord, size_bytes, content`` and more."""
    return spark.read.format(file_format).load(path)


def read_file_tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Checked-out files below ``root/<repo>/...`` as a file table (operator S1).

    Bytes that are not UTF-8 are dropped.  ``root`` is cut off where it first occurs.  The ordinal
    is drawn from the path inside the repository, so it does not depend on how files are packed into
    splits: an order of files that is the same in every run.
    """
    binary = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(root)
    )
    base = root.rstrip("/") + "/"
    after = F.substr(F.col("path"), F.instr(F.col("path"), F.lit(base)) + len(base))
    relative = F.regexp_replace(after, r"\A/+", "")
    named = binary.select(
        F.substring_index(relative, "/", 1).alias("repo"), relative.alias("path"),
        F.col("length").alias("size_bytes"), decode_ignoring(F.col("content")).alias("content"),
    )
    return named.withColumn("file_ord", F.pmod(F.xxhash64("path"), F.lit(1 << 56)))


def decode_ignoring(content: Column) -> Column:
    """Decode UTF-8 and drop the bytes that are not, and only those."""
    text = content.cast("string")
    valid = F.regexp_replace(F.decode(content, "ISO-8859-1"), f"((?:{_UTF8})++)|[\\x00-\\xff]", "$1")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.encode(valid, "ISO-8859-1").cast("string"))


def write_file_table(files: DataFrame, table: str, buckets: int, mode: str = "overwrite") -> None:
    """Store a file table in ``buckets`` by repository, so that joins on it move no contents (operators P11, A12)."""
    files.write.mode(mode).format("parquet").bucketBy(buckets, "repo").sortBy("repo").saveAsTable(table)


def code_files(files: DataFrame) -> DataFrame:
    """Supported code files (operator S2); directory entries are dropped."""
    return files.where(~F.endswith("path", F.lit("/")) & is_code_file(F.col("path")))


def manifest_files(files: DataFrame) -> DataFrame:
    """Dependency manifests with their ecosystem (operator S3)."""
    kind = manifest_type(F.col("path"))
    return files.where(~F.endswith("path", F.lit("/")) & is_manifest(F.col("path"))).withColumn(
        "ecosystem", lookup(rules.MANIFEST_ECOSYSTEMS, kind, "")
    )
