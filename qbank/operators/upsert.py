"""A batch into a bank by fingerprint: a fold that depends on the order of rows, with no array of all rows of a fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qbank.functions.text import basename
from qbank.operators import ranks
from qbank.sources.stage import staged

#: Columns that change together with stem and answer; a column that one side lacks is left out.
CARRIED = ("options", "explanation")
_OWN = {"content_hash", "id", "seq", "question", "answer", "pending_review", "source_file", "files", "images", *CARRIED}


def _anchored(c: Column) -> Column:
    return F.contains(c, F.lit("【图:"))


def _names(rows: DataFrame, images: bool, part: int) -> tuple[Column, Column]:
    """Source files and image names of rows in order, as arrays."""
    none = F.array().cast("array<string>")
    files = F.col("files") if "files" in rows.columns else F.filter(F.array("source_file"), lambda x: x != "")
    own = F.col("images") if part == 0 else F.filter(F.transform("images", basename), lambda x: x.isNotNull())
    return F.coalesce(files, none), F.coalesce(own, none) if images else none


def _telling(rows: DataFrame) -> DataFrame:
    """The rows that can tell in the fold: a handful of each fingerprint and stretch of the order, whatever these hold.

    Read from the end: a row with another answer than the last one, as what comes before it is overwritten; of the rows after it,
    only those with anchors if there are any (others cannot take them away), of these the first row of the last run of one stem
    and the row before that run; and a row that waits for review, in or before the run. The fold over these gives what the fold
    over all rows gives, from any state before.
    """
    rows = rows.withColumn("stretch", ranks.stretches(rows, "seq", "part"))
    whole = Window.partitionBy("content_hash", "part", "stretch")
    back = whole.orderBy(F.desc("seq"), F.desc("question"), F.desc("answer"))
    entire = back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = lambda c: F.sum(c.cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0))
    question, seq = F.col("question"), F.col("seq")
    r = rows.withColumn("other", F.col("answer") != F.first("answer").over(entire))
    r = r.withColumn("others", so_far(F.col("other"))).withColumn("late", F.col("others") == 0)
    r = r.withColumn("holds", F.max(F.col("late") & _anchored(question)).over(whole)).withColumn("counts", F.col("late") & (~F.col("holds") | _anchored(question)))
    r = r.withColumn("differs", F.col("counts") & (question != F.first(F.when(F.col("counts"), question), ignorenulls=True).over(entire)))
    r = r.withColumn("breaks", so_far(F.col("differs")))
    r = r.withColumn("run", F.min(F.when(F.col("counts") & (F.col("breaks") == 0), seq)).over(whole))
    waits = lambda when: F.max(F.when(F.col("late") & F.col("pending_review") & when, seq)).over(whole)
    r = r.withColumn("waits", waits(seq >= F.col("run"))).withColumn("waited", waits(seq < F.col("run")))
    tells = (
        (F.col("other") & (F.col("others") == 1)) | (F.col("differs") & (F.col("breaks") == 1))
        | (F.col("late") & (seq.eqNullSafe(F.col("run")) | seq.eqNullSafe(F.col("waits")) | seq.eqNullSafe(F.col("waited"))))
    )
    return r.where(tells).select(*rows.columns)


def _folded(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Stem, answer, review flag and what goes with them after all rows of each fingerprint, in order."""
    item = F.struct("part", "seq", "question", "answer", "pending_review", *carried)
    grouped = _telling(rows).groupBy("content_hash").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    anchored = "contains({}.question, '【图:')"
    changed = f"((r.question <> s.question AND NOT ({anchored.format('s')} AND NOT {anchored.format('r')})) OR r.answer <> s.answer)"
    kept = ", ".join(f"'{c}', if({changed}, r.{c}, s.{c})" for c in ("question", "answer"))
    rest = "".join(f", '{c}', if({changed}, r.{c}, s.{c})" for c in carried)
    step = f"(s, r) -> named_struct('part', r.part, 'seq', r.seq, {kept}, 'pending_review', if({changed}, r.pending_review, s.pending_review OR r.pending_review){rest})"
    return grouped.select("content_hash", F.expr(f"aggregate(slice(rows, 2, size(rows)), rows[0], {step})").alias("s")).select(
        "content_hash", "s.question", "s.answer", "s.pending_review", *[f"s.{c}" for c in carried]
    )


def _sides(bank: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of both sides, written and read again, as the fold, the keys and the lists all read them."""
    images = "images" in bank.columns and "images" in batch.columns
    both = lambda c: c in bank.columns and c in batch.columns
    carried = [c for c in CARRIED if both(c)]
    others = [c for c in bank.columns if c not in _OWN and both(c)]

    def side(rows: DataFrame, part: int, seq: str) -> DataFrame:
        files, names = _names(rows, images, part)
        text = [F.coalesce(c, F.lit("")).alias(c) for c in ("question", "answer")]
        # As a new value, not the column itself: two sides that are dealt by fingerprint already would make a union that claims to be
        # so too, which Spark 4.1.2 does not keep to when it coalesces the two sides differently.
        return rows.select(
            F.concat("content_hash", F.lit("")).alias("content_hash"), F.lit(part).alias("part"), F.col(seq).alias("seq"), *text, F.coalesce("pending_review", F.lit(False)).alias("pending_review"),
            *carried, files.alias("files"), names.alias("images"), F.struct(F.lit(part).alias("part"), *others).alias("base"),
        )

    return staged(side(bank, 0, "id").union(side(batch, 1, "seq")))


def _merged(rows: DataFrame, bank: DataFrame, batch: DataFrame) -> DataFrame:
    """upsert's rows, of what _sides gave for bank and batch."""
    images = "images" in bank.columns and "images" in batch.columns
    carried = [c for c in CARRIED if c in rows.columns]
    others = [c for c in rows.schema["base"].dataType.names if c != "part"]
    text = _folded(rows.select("content_hash", "part", "seq", "question", "answer", "pending_review", *carried), carried)
    first = rows.groupBy("content_hash").agg(F.min(F.when(F.col("part") == 0, F.col("seq"))).alias("id"), F.min_by("base", F.struct("part", "seq")).alias("base"))
    kinds = [("files", "files"), *([("images", "images")] if images else [])]
    listed = [rows.select("content_hash", F.lit(k).alias("kind"), "part", "seq", F.posexplode(c).alias("i", "name")) for k, c in kinds]
    listed = (listed[0].union(listed[1]) if images else listed[0]).groupBy("content_hash", "kind", "name").agg(F.min(F.struct("part", "seq", "i")).alias("at"))
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("at", "name")))), lambda x: x["name"]).alias(k)
    lists = listed.groupBy("content_hash").agg(*[of(k) for k, _ in kinds])
    none = F.array().cast("array<string>")
    out = text.join(first, "content_hash").join(lists, "content_hash", "left")
    return out.select(
        "content_hash", F.col("id").cast(bank.schema["id"].dataType).alias("id"), *[f"base.{c}" for c in others], "question", "answer", *carried, "pending_review", *[F.coalesce(k, none).alias(k) for k, _ in kinds]
    )


def upsert(bank: DataFrame, batch: DataFrame) -> DataFrame:
    """One row for each fingerprint after bank (in the order of id) and batch (in the order of seq) are taken in turn.

    A later row replaces stem, answer, options, explanation and review flag if the stem changed (unless that would lose anchors)
    or the answer did; a row that waits for review makes the question wait. Source files are collected in order, and images where
    both sides have them, those of the batch as file names. All other columns that both have are those of the first row. id is
    the bank's least, null where the question is new. The bank may have files, an array, in place of source_file: what an earlier
    upsert gave.

    Rows of one fingerprint are cut into stretches of the order, each of which leaves a handful of rows that can tell; only these
    are gathered. Names and first rows are aggregates. So no task holds a fingerprint's rows, however many there are.
    """
    return _merged(_sides(bank, batch), bank, batch)


def upsert_batch(bank: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bank after the batch, and (seq, id, outcome) for each of its rows: inserted if the fingerprint is new, else merged.

    New questions get the ids that follow the bank's greatest, in the order in which they first come in the batch.
    """
    rows = _sides(bank, batch)
    of = lambda part: F.min(F.when(F.col("part") == part, F.col("seq")))
    keys = rows.groupBy("content_hash").agg(of(0).cast(bank.schema["id"].dataType).alias("id"), of(1).cast(batch.schema["seq"].dataType).alias("first"))
    keys = staged(keys.where("first IS NOT NULL"))
    top = rows.where("part = 0").agg(F.coalesce(F.max("seq"), F.lit(0)).cast(bank.schema["id"].dataType).alias("top"))
    new = ranks.numbered(keys.where("id IS NULL AND content_hash IS NOT NULL").select("content_hash", "first"), "first")
    ids = new.crossJoin(F.broadcast(top)).select("content_hash", (F.col("top") + F.col("n")).alias("_new"))
    after = _merged(rows, bank, batch).join(ids, "content_hash", "left").withColumn("id", F.coalesce("id", "_new")).drop("_new")
    known = keys.join(ids, "content_hash", "left").select(
        "content_hash", F.coalesce("id", "_new").alias("id"), F.when(F.col("id").isNull(), F.col("first")).alias("_first")
    )
    asked = rows.where("part = 1").select("content_hash", F.col("seq").cast(batch.schema["seq"].dataType).alias("seq"))
    done = asked.join(known, "content_hash").select("seq", "id", F.when(F.col("seq") == F.col("_first"), "inserted").otherwise("merged").alias("outcome"))
    return after, done


def append_sources(questions: DataFrame, additions: DataFrame) -> DataFrame:
    """Questions (content_hash, files, pending_review) with the source files of additions (content_hash, seq, source_file,
    pending_review) at the end, in order and each once; an addition that waits for review makes the question wait. Texts stay."""
    named = additions.where("source_file <> ''").groupBy("content_hash", "source_file").agg(F.min("seq").alias("seq"))
    lists = named.groupBy("content_hash").agg(F.array_sort(F.collect_list(F.struct("seq", "source_file"))).alias("_new"))
    waits = additions.groupBy("content_hash").agg(F.bool_or("pending_review").alias("_waits"))
    new = F.transform(F.coalesce("_new", F.array().cast("array<struct<seq:bigint,source_file:string>>")), lambda x: x["source_file"])
    return questions.join(waits, "content_hash", "left").join(lists, "content_hash", "left").withColumns(
        {"files": F.array_union("files", new), "pending_review": F.col("pending_review") | F.coalesce("_waits", F.lit(False))}
    ).drop("_new", "_waits")
