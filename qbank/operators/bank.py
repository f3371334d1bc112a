"""Browsing and changing a bank: filters, pages, counts, patches and upserts, each as one job over all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qbank.functions.text import basename, content_hash, has_answer, normalize_qtype, qtype_label, strip
from qbank.operators import ranks
from qbank.schemas import QTYPES


def prepare(bank: DataFrame) -> DataFrame:
    """A raw bank with normalised type and fingerprint."""
    return bank.withColumn("qtype", normalize_qtype(F.col("qtype_raw"))).withColumn("content_hash", content_hash(F.col("question"), F.col("answer")))


def by_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """B1: the rows of the given ids."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def first_by_text(bank: DataFrame, texts: DataFrame) -> DataFrame:
    """B2: the least id with each stem asked for."""
    return bank.join(texts.select("question").distinct(), "question", "left_semi").groupBy("question").agg(F.min("id").alias("id"))


def first_by_hash(bank: DataFrame, hashes: DataFrame) -> DataFrame:
    """The least id with each fingerprint asked for; an empty one finds nothing."""
    wanted = hashes.select("content_hash").where("content_hash <> ''").distinct()
    return bank.join(wanted, "content_hash", "left_semi").groupBy("content_hash").agg(F.min("id").alias("id"))


def matching(bank: DataFrame, subject: str = "", qtype: str = "", keyword: str = "") -> DataFrame:
    """Rows of a subject, a type in any spelling, and a keyword in stem, topic or subject; '' asks for all."""
    out = bank
    if subject:
        out = out.where(F.col("subject") == subject)
    if qtype:
        out = out.where(F.col("qtype") == normalize_qtype(F.lit(qtype)))
    if keyword:
        fields = [F.coalesce(F.col(c), F.lit("")).ilike(f"%{keyword}%") for c in ("question", "topic", "subject") if c in bank.columns]
        out = out.where(reduce(Column.__or__, fields))
    return out


def page(rows: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """a page in falling id; page from 1, size between 1 and 200."""
    size = min(200, max(1, size))
    return rows.orderBy(F.desc("id")).offset((max(1, number) - 1) * size).limit(size)


def pending(bank: DataFrame) -> DataFrame:
    """Rows that wait for review."""
    return bank.where("pending_review")


def without_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """What is left when positive ids are deleted."""
    return rows.join(ids.where("id > 0").select("id").distinct(), "id", "left_anti")


def clear_pending(bank: DataFrame, ids: DataFrame) -> DataFrame:
    """B12."""
    hit = ids.select("id").distinct().withColumn("hit", F.lit(True))
    return bank.join(hit, "id", "left").withColumn("pending_review", F.when(F.col("hit"), False).otherwise(F.col("pending_review"))).drop("hit")


def patch(bank: DataFrame, changes: DataFrame, columns: tuple[str, ...], trim: bool = False, resolve: bool = False) -> DataFrame:
    """Columns of the same ids replaced (null keeps, '' clears); the fingerprint follows; resolve ends the review."""
    renamed = changes.select("id", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = bank.join(renamed, "id", "left")
    for c in columns:
        new = strip(F.col(f"_{c}")) if trim else F.col(f"_{c}")
        out = out.withColumn(c, F.coalesce(new, F.col(c)))
    if resolve:
        out = out.withColumn("pending_review", F.when(F.col("_hit"), False).otherwise(F.col("pending_review")))
    out = out.withColumn("content_hash", content_hash(F.col("question"), F.col("answer")))
    return out.drop("_hit", *[f"_{c}" for c in columns])


def insert(bank: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch rows appended in the order of seq, with the ids that follow the bank's greatest; numbered by stretches of seq, so
    no task holds the batch, however its seq is spread."""
    top = bank.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = ranks.numbered(batch, "seq").crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("n"))
    return bank.unionByName(rows.select(*bank.columns))


def subjects(bank: DataFrame) -> DataFrame:
    """D2."""
    return bank.groupBy("subject").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject")


def qtype_counts(bank: DataFrame) -> DataFrame:
    """D3: a row for each of the seven types in order, 0 where the bank has none."""
    dim = bank.sparkSession.createDataFrame(list(enumerate(QTYPES)), "pos int, qtype string")
    counts = bank.groupBy("qtype").agg(F.count("*").alias("n"))
    return dim.join(counts, "qtype", "left").select("pos", "qtype", qtype_label(F.col("qtype")).alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def stats(bank: DataFrame, records: DataFrame) -> DataFrame:
    """Totals, by subject and by type, in one scan of the bank; the number of records with the totals, else 0."""
    held = records.agg(F.count("*").alias("records"))
    return bank.groupingSets([[], ["subject"], ["qtype"]], "subject", "qtype").agg(
        F.count("*").alias("n"), F.count_if("pending_review").alias("n_pending"), (F.grouping_id() == 3).alias("whole")
    ).crossJoin(F.broadcast(held)).select("subject", "qtype", "n", "n_pending", F.when(F.col("whole"), F.col("records")).otherwise(0).alias("n_records"))


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, taken with an aggregate that combines before the shuffle."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def sampled(rows: DataFrame, keys: list[str], n: Column | int, seed: int = 42) -> DataFrame:
    """F2, I8: the n rows of each key that come first by a seeded hash of id; repeatable."""
    w = Window.partitionBy(*keys).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def answered(bank: DataFrame) -> DataFrame:
    return bank.withColumn("has_answer", has_answer(F.col("answer")))


def outcomes(bank: DataFrame, batch: DataFrame) -> DataFrame:
    """C11: each batch row as merged (its fingerprint is in the bank or came earlier in the batch) or inserted."""
    known = bank.select("content_hash").distinct().withColumn("known", F.lit(True))
    first = batch.groupBy("content_hash").agg(F.min("seq").alias("first"))
    return batch.join(known, "content_hash", "left").join(first, "content_hash").withColumn(
        "outcome", F.when(F.col("known") | (F.col("seq") > F.col("first")), "merged").otherwise("inserted")
    ).drop("known", "first")


def import_summary(done: DataFrame) -> DataFrame:
    """By type, what was inserted, merged and waits for review."""
    return done.groupBy("qtype").agg(
        F.count_if(F.col("outcome") == "inserted").alias("inserted"), F.count_if(F.col("outcome") == "merged").alias("merged"),
        F.count_if("pending_review").alias("pending"), F.count("*").alias("total"),
    )


def set_images(rows: DataFrame, patch: DataFrame) -> DataFrame:
    """Rows whose id the patch names get its images, as file names; names that are no file name go."""
    names = F.filter(F.transform("images", basename), lambda x: x.isNotNull())
    return rows.join(patch.select("id", names.alias("_images")), "id", "left").withColumn("images", F.coalesce("_images", "images")).drop("_images")


def variants(rows: DataFrame, subject: str = "默认", source: str = "变式生成") -> DataFrame:
    """Reviewed variants as a batch to import; a blank subject and a missing source get their defaults."""
    given = F.when(strip(F.coalesce("subject", F.lit(""))) != "", F.col("subject")).otherwise(F.lit(subject))
    out = rows.withColumn("subject", given)
    return out if "source_file" in rows.columns else out.withColumn("source_file", F.lit(source))
