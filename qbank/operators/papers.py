"""Papers: assembling them by repeatable sampling, and grading submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qbank.functions.answers import check_answers, references
from qbank.functions.text import has_answer

from .bank import sampled


def practice(bank: DataFrame, per_subject: int, qtype: str, points: int = 10, seed: int = 42) -> DataFrame:
    """I8: so many questions of a type for each subject, 10 points each."""
    return sampled(bank.where(F.col("qtype") == qtype), ["subject"], per_subject, seed).select("subject", "rank", "id", F.lit(points).alias("points"))


def build(bank: DataFrame, sections: DataFrame, seed: int = 42) -> DataFrame:
    """Questions of each (paper, subject, pos, qtype, count, score); '' for all subjects; sections without a count go."""
    wanted = sections.where("count > 0")
    # The rank is taken once for each subject and type, before papers multiply the rows.
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), F.col("id")]
    most = wanted.groupBy("qtype").agg(F.max("count").alias("most"))
    ranked = bank.select("id", "subject", "qtype").join(F.broadcast(most), "qtype").withColumn(
        "rank", F.row_number().over(Window.partitionBy("subject", "qtype").orderBy(*order))
    ).where(F.col("rank") <= F.col("most"))
    one = wanted.where("subject <> ''").join(ranked, ["subject", "qtype"]).where("rank <= count")
    total = Window.partitionBy("paper", "pos").orderBy(*order)
    every = wanted.where("subject = ''").drop("subject").join(ranked, "qtype").withColumn("rank", F.row_number().over(total)).where("rank <= count")
    columns = ["paper", "pos", "qtype", "rank", "id", "score"]
    return one.select(columns).unionByName(every.select(columns))


def totals(picked: DataFrame) -> DataFrame:
    """Questions and points of each paper, from what was found."""
    return picked.groupBy("paper").agg(F.count("*").alias("question_count"), F.sum("score").alias("total_score"))


def last_answers(submissions: DataFrame) -> DataFrame:
    """Of several answers to one question of a paper the last one counts."""
    return submissions.groupBy("paper_id", "question_id").agg(F.max_by("user_answer", "event_id").alias("user_answer"))


def grade(bank: DataFrame, submissions: DataFrame) -> DataFrame:
    """Status of each answer: pending without a stored answer or for open questions, else correct or wrong.

    Stored answers are read once for each question, before the submissions multiply them.
    """
    own = references(bank.select(F.col("id").alias("question_id"), "qtype", "answer"), "answer")
    own = own.withColumn("_open", ~has_answer(F.col("answer")) | F.col("qtype").isin("essay", "thinking"))
    checked = check_answers(last_answers(submissions).join(own, "question_id"), "user_answer", "answer")
    return checked.withColumn("status", F.when(F.col("_open"), "pending").when(F.col("ok"), "correct").otherwise("wrong")).drop("_open")


def rollup(graded: DataFrame, points: Column | int = 10) -> DataFrame:
    """Points, counts and status of each record; points are a number, or a column with those of each item, whose sum is rounded
    to two places, half to even."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    score = is_("correct") * points if isinstance(points, int) else F.bround(F.coalesce(F.sum(F.when(F.col("status") == "correct", points)), F.lit(0.0)), 2)
    return graded.groupBy("paper_id").agg(
        score.alias("score"), is_("correct").alias("n_correct"), is_("wrong").alias("n_wrong"), is_("pending").alias("n_pending")
    ).withColumn("status", F.when(F.col("n_pending") > 0, "pending").otherwise("graded"))


def paper_id(time: Column, key: Column) -> Column:
    """P, the time to the second and four digits of the key's hash, so that a rerun gives the same id."""
    return F.concat(F.lit("P"), F.date_format(time, "yyyyMMddHHmmss"), F.substring(F.md5(key.cast("string")), 1, 4))
