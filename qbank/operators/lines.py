"""Lines of documents in order: what they carry forward, and the blocks they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(docs: DataFrame) -> DataFrame:
    """The lines of each text with their places, from 0."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


def _so_far(key: str, order: str) -> Window:
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def carry_forward(rows: DataFrame, value: Column, name: str, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """The last value that is not null, up to and with each row; null before the first."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(_so_far(key, order)))


def block_ids(rows: DataFrame, begins: Column, name: str = "block", key: str = "doc_id", order: str = "pos") -> DataFrame:
    """The number of rows so far that begin a block; 0 before the first."""
    return rows.withColumn(name, F.sum(begins.cast("int")).over(_so_far(key, order)))
