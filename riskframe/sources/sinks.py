"""Where results go (operators S5, S6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.operators.findings import explain_findings, finding_rows
from riskframe.operators.quota import USAGE_KEYS
from riskframe.sources.log_table import LogTable, _Files

USAGE_SCHEMA = "actor_key string, usage_date date, scan_count long"


def write_reports(reports: DataFrame, path: str, keys: list[str], file_format: str = "parquet", batch: int = 0) -> None:
    """Write file reports and their findings as two tables below ``path`` (operator S6).

    A batch owns a folder in each table and counts once its number stands in ``commits``, which is written last: readers see both
    tables of a batch or none of it, and a batch that runs again after a crash at any step gives the same tables.  The report is
    written first and the findings are cut from the written rows, so texts are scanned once.  Explanations are constants per
    key and join on reading (:func:`read_findings`) instead of being stored with every finding.
    """
    spark, files = reports.sparkSession, _Files(reports.sparkSession, path)
    if batch in committed(spark, path):
        return
    reports.write.mode("overwrite").format(file_format).save(f"{path}/reports/batch={batch}")
    written = spark.read.schema(reports.schema).format(file_format).load(f"{path}/reports/batch={batch}")
    finding_rows(written, "findings", keys).write.mode("overwrite").format(file_format).save(f"{path}/findings/batch={batch}")
    files.replace(f"commits/{batch}", "")


def committed(spark: SparkSession, path: str) -> list[int]:
    """The batches whose tables are whole."""
    files = _Files(spark, path)
    if not files.system.exists(files.at("commits")):
        return []
    names = [status.getPath().getName() for status in files.system.listStatus(files.at("commits"))]
    return sorted(int(n) for n in names if n.isdigit())


def _committed_rows(spark: SparkSession, path: str, table: str, file_format: str) -> DataFrame:
    folders = [f"{path}/{table}/batch={b}" for b in committed(spark, path)]
    return spark.read.format(file_format).option("basePath", f"{path}/{table}").load(folders).drop("batch")


def read_reports(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """The reports of all committed batches."""
    return _committed_rows(spark, path, "reports", file_format)


def read_findings(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Findings of all committed batches with their explanation and guidance."""
    return explain_findings(_committed_rows(spark, path, "findings", file_format))


def usage_table(spark: SparkSession, path: str) -> LogTable:
    return LogTable(spark, path, USAGE_KEYS, USAGE_SCHEMA)


def write_usage_batch(updates: DataFrame, path: str, batch_id: int) -> None:
    """Store one batch of changed usage counts (operator S5).

    The cost follows the changed keys; batches are merged into a snapshot now and then, so reading does not grow with their
    number, and a retry changes nothing.
    """
    usage_table(updates.sparkSession, path).write(updates, batch_id)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """The current count per actor and day."""
    return usage_table(spark, path).read()
