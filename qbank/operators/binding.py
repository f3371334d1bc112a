"""Images to questions: by number, then in order, with what is left over."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qbank.functions.text import anchors, strip


class Bound(NamedTuple):
    """questions with anchors; leftovers (doc, name, nth) in order; counts (doc, certain, uncertain, leftover)."""

    questions: DataFrame
    leftovers: DataFrame
    counts: DataFrame


def anchor(name: Column) -> Column:
    return F.concat(F.lit("【图:"), name, F.lit("】"))


def _lists(images: DataFrame, doc: str) -> DataFrame:
    """The names that carry a number, in order, for each document and number."""
    rows = images.where("key IS NOT NULL").groupBy(doc, "key").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("_x"))
    return rows.select(doc, F.col("key").alias("_key"), F.transform("_x", lambda x: x["name"]).alias("_names"))


def _with_anchors(question: Column, names: Column) -> Column:
    return strip(F.concat_ws(" ", question, F.array_join(F.transform(names, anchor), " ")))


def bind_by_number(questions: DataFrame, images: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Questions (doc, qnum, question) with the anchors of the images (doc, place, name, key) of their number at the end, and
    matched, how many these are. Of two questions with one number both get them."""
    joined = questions.withColumn("_key", F.col("qnum").cast("string")).join(_lists(images, doc), [doc, "_key"], "left")
    joined = joined.withColumn("matched", F.when(F.col("_names").isNull(), 0).otherwise(F.size("_names")))
    return joined.withColumn("question", F.when(F.col("matched") > 0, _with_anchors(F.col("question"), F.col("_names"))).otherwise(F.col("question"))).drop("_key", "_names")


def bind(questions: DataFrame, images: DataFrame, doc: str = "doc_id") -> Bound:
    """Images (doc, place, name, key; key null: no number) go to questions (doc, pos, qnum, question, pending_review).

    First by number. What is left, the images without a number and then those whose number no question has (numbers in the order
    of their first image), goes one by one to the questions that have no anchor yet, in order; each of these waits for review.
    What no question is left for is leftover. Documents none of whose images has a number keep their questions as they are, and
    all their images are leftover: see zip_images. Both sides are numbered within the document and joined by that number.
    """
    asked = questions.where("qnum IS NOT NULL").select(doc, F.col("qnum").cast("string").alias("key"), F.lit(True).alias("_has")).distinct()
    known = images.withColumns({
        "_numbered": F.max(F.col("key").isNotNull()).over(Window.partitionBy(doc)), "_first": F.when(F.col("key").isNotNull(), F.min("place").over(Window.partitionBy(doc, "key"))),
    })
    rest = known.join(asked, [doc, "key"], "left").where("key IS NULL OR _has IS NULL")
    rest = rest.withColumn("nth", F.row_number().over(Window.partitionBy(doc).orderBy(F.asc_nulls_first("_first"), "place"))).select(doc, "name", "nth", "_numbered")
    queue = rest.where("_numbered").select(doc, "name", "nth")
    q = bind_by_number(questions, images, doc).withColumn("_free", ~F.contains("question", F.lit("【图:")))
    q = q.withColumn("nth", F.when(F.col("_free"), F.row_number().over(Window.partitionBy(doc, "_free").orderBy("pos"))))
    q = q.join(queue.withColumnRenamed("name", "_name"), [doc, "nth"], "left")
    given = F.col("_name").isNotNull()
    q = q.withColumns({
        "question": F.when(given, _with_anchors(F.col("question"), F.array("_name"))).otherwise(F.col("question")),
        "pending_review": F.col("pending_review") | given, "uncertain": given.cast("int"),
    }).drop("_name")
    free = q.where("nth IS NOT NULL").groupBy(doc).agg(F.max("nth").alias("_free"))
    taken = F.when(F.col("_numbered"), F.coalesce("_free", F.lit(0))).otherwise(0)
    left = rest.join(free, doc, "left").where(F.col("nth") > taken).select(doc, "name", "nth")
    of_questions = q.groupBy(doc).agg(F.sum("matched").alias("certain"), F.sum("uncertain").cast("long").alias("uncertain"))
    counts = of_questions.join(left.groupBy(doc).agg(F.count("*").alias("leftover")), doc, "full").na.fill(0, ["certain", "uncertain", "leftover"])
    return Bound(q.drop("_free", "nth", "matched", "uncertain"), left, counts)


def zip_images(questions: DataFrame, images: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Questions with images, the name of the i-th image for the i-th question of a document; none of them gets an anchor."""
    nth = lambda order: F.row_number().over(Window.partitionBy(doc).orderBy(order))
    own = images.withColumn("_nth", nth("place")).select(doc, "_nth", F.array("name").alias("_own"))
    q = questions.withColumn("_nth", nth("pos")).join(own, [doc, "_nth"], "left")
    return q.withColumn("images", F.coalesce("_own", F.array().cast("array<string>"))).drop("_nth", "_own")


def settle(questions: DataFrame) -> DataFrame:
    """G4 of an import: images as the sorted union of what is there and the stem's anchors."""
    return questions.withColumn("images", F.array_sort(F.array_distinct(F.array_union("images", anchors(F.col("question"))))))
