"""Tables that an operator writes once in the folder that the driver and all executors share, and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where the session names none and runs in one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tofcube.work.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-work-")
        spark.conf.set("tofcube.work.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder: lineage ends there, and what was decided by its partitions stays as it is."""
    path = f"{shared_folder(df.sparkSession)}/tofcube-{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
