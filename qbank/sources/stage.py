"""Results that several later steps read: written once to the folder that driver and executors share, and read from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A folder of the application in the one that the cluster names in spark.checkpoint.dir; where that is unset, local mode gets
    one of its own (tests). Whoever looks after the shared folder removes it when the application has ended."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/bank-{spark.sparkContext.applicationId}"


def staged(df: DataFrame) -> DataFrame:
    """df, written and read again: computed once, whatever reads it, and read from files where an executor is lost."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
