"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets one of its own, as there all tasks share the
    disk; on a cluster the setting is demanded.
    """
    folder = spark.sparkContext.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {SETTING} to a folder that driver and executors share")
    folder = f"{spark.sparkContext.getConf().get('spark.local.dir') or '/tmp'}/riskframe-{uuid.uuid4().hex}"
    spark.conf.set(SETTING, folder)
    return folder
