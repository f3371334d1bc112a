"""Readers and writers of a bank's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from qbank.functions.text import strip

# Headings of an exported record, in the order of its columns, and suffixes of images.
EXPORT_HEADINGS = ("题号", "题目", "标准答案", "作答", "状态", "得分", "点评")
EXPORT_COLUMNS = ("n", "question", "correct_answer", "user_answer", "status", "score", "comment")
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "gif", "bmp", "webp")


def decode_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """A1: JSON text columns as arrays of strings; empty where null, blank or no array."""
    for c in columns:
        df = df.withColumn(c, F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")))
    return df


@F.pandas_udf(StringType())
def _other_encoding(content: pd.Series) -> pd.Series:
    """Bytes that are no UTF-8: GB18030 if they are valid there, else UTF-8 with replacement characters. Spark's own decode knows
    neither that charset nor a way on from bytes that are invalid, so the rows that need it, and only these, come here."""

    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        try:
            return bytes(data).decode("gb18030")
        except UnicodeDecodeError:
            return bytes(data).decode("utf-8", "replace")

    return content.map(one)


def decode_text(files: DataFrame) -> DataFrame:
    """A2: path, text and encoding of rows as binaryFile reads them: UTF-8 if it is valid (a leading mark goes), else GB18030, else
    UTF-8 with replacement characters (encoding: replaced). Null content gives null text."""
    raw = F.col("content").cast("string")
    marked = files.withColumn("_utf8", F.is_valid_utf8(raw)).withColumn("_other", _other_encoding(F.when(~F.col("_utf8"), F.col("content"))))
    own = F.col("_utf8")
    text = F.when(own, F.regexp_replace(raw, "^\ufeff", "")).otherwise(F.col("_other"))
    encoding = F.when(own, "utf-8").when(F.contains("_other", F.lit("\ufffd")), "replaced").when(F.col("_other").isNotNull(), "gb18030")
    return marked.select("path", text.alias("text"), encoding.alias("encoding"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.{txt,md,text}") -> DataFrame:
    """A2: the text files below a folder, each a row of decode_text; Spark reads no file that is empty."""
    return decode_text(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content"))


def cells_to_line(cells: Column) -> Column:
    """A3: cells that are not blank, trimmed, joined by bars."""
    return F.array_join(F.filter(F.transform(cells, strip), lambda x: x != ""), " | ")


def export_items(records: DataFrame) -> DataFrame:
    """The answers of records as rows, numbered from 1."""
    return records.select("paper_id", F.posexplode("answers")).select("paper_id", (F.col("pos") + 1).alias("n"), "col.*")


def export_csv(items: DataFrame, path: str, record: str = "paper_id", apart: bool = True) -> None:
    """A4: the items (n, question, correct_answer, user_answer, status, score, comment) of each record as CSV in a folder of its own,
    with the headings; a byte-order mark comes first, as it is part of the first heading. Rows of a record are in one file, in order.

    Where there are so many records that a file for each is what takes the time, apart=False puts many into one file, one after the
    other, with the record as the last column; there are as many files as tasks then, however many records.
    """
    columns = [F.col(c).alias(("\ufeff" if i == 0 else "") + h) for i, (c, h) in enumerate(zip(EXPORT_COLUMNS, EXPORT_HEADINGS, strict=True))]
    rows = items.repartition(record).sortWithinPartitions(record, "n").select(*columns, record)
    out = rows.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    (out.partitionBy(record) if apart else out).csv(path)


def read_exported(spark: SparkSession, path: str, record: str = "paper_id string") -> DataFrame:
    """A4: what export_csv wrote, under the names of its columns; record names and types the folders' key or the last column."""
    schema = "n int, question string, correct_answer string, user_answer string, status string, score double, comment string"
    return spark.read.schema(f"{schema}, {record}").options(header=True, escape='"', multiLine=True, nullValue="\u0000").csv(path)


def export_json(records: DataFrame, path: str, record: str = "paper_id") -> None:
    """A4: one JSON object for each record, with its answers, in a folder of its own; empty fields are written too."""
    records.repartition(record).write.mode("overwrite").option("ignoreNullFields", False).partitionBy(record).json(path)


def append(rows: DataFrame, path: str, batch: str) -> None:
    """Rows appended as a batch. A batch that is written again, after a failure or by mistake, takes the place of what it wrote
    before, so each of its rows is there once; other batches stay as they are."""
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def write_papers(papers: DataFrame, path: str) -> None:
    """A5: papers (id, ...) as JSON, each in a folder of its own. A paper that is saved again takes the place of the old one."""
    out = papers.repartition("id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False)
    out.partitionBy("id").json(path)


def read_papers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A5: saved papers with id, path and damaged, which holds the text of a file that is no paper (null for all others)."""
    rows = spark.read.schema("value string, id string").option("wholetext", True).text(path)
    paper = F.from_json("value", f"{schema}, damaged string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "damaged"})
    return rows.select("id", paper.alias("p"), F.col("_metadata.file_path").alias("path")).select("id", "p.*", "path")


def list_papers(papers: DataFrame) -> DataFrame:
    """A5: what was read whole, the newest first by file name."""
    return papers.where("damaged IS NULL").orderBy(F.desc("path"))


def backfill(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns that are missing are added with their default, nulls get it; doing it twice changes nothing."""
    for name, default in columns.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), default) if name in rows.columns else default)
    return rows


def index_snapshot(bank: DataFrame) -> DataFrame:
    """A8."""
    return bank.select("id", F.substring("question", 1, 200).alias("head"), "subject", "qtype")


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files under a path; files are listed by their names and never opened."""
    either = lambda suffix: "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    pattern = "*.{" + ",".join(map(either, IMAGE_SUFFIXES)) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")
