"""Stored replies of a language model, and the prompts that ask for them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ANCHOR, let, strip

# Kinds of images; whatever else a reply names is "other".
IMAGE_KINDS = ("diagram", "formula", "symbol", "data_table", "decorative", "other")
MOST_VARIANTS = 10


def _between(c: Column, first: str, last: str) -> Column:
    """From the first opening sign to the last closing one; null if there is none."""
    return F.nullif(F.regexp_extract(c, rf"(?s)(\{first}.*\{last})", 1), F.lit(""))


def variants(reply: Column) -> Column:
    """Array of (question, options, correct_answer, explanation) in a reply, at most ten; null if it holds no JSON array.

    A fence of code around the array and text before and after it are left out, as are variants without a stem and blank options.
    """
    bare = F.regexp_replace(F.regexp_replace(strip(reply), r"(?U)^```[a-zA-Z]*\s*", ""), r"(?U)\s*```$", "")
    shape = "array<struct<question:string,options:array<string>,correct_answer:string,explanation:string>>"
    text = lambda x: strip(F.coalesce(x, F.lit("")))

    def item(x: Column) -> Column:
        options = F.filter(F.transform(F.coalesce(x["options"], F.array().cast("array<string>")), text), lambda o: o != "")
        return F.struct(text(x["question"]).alias("question"), options.alias("options"), text(x["correct_answer"]).alias("correct_answer"), text(x["explanation"]).alias("explanation"))

    return let(F.from_json(_between(bare, "[", "]"), shape), lambda a: F.filter(F.transform(F.slice(a, 1, MOST_VARIANTS), item), lambda x: x["question"] != ""))


def variant_rows(replies: DataFrame, key: str, reply: str) -> DataFrame:
    """H31 as rows: key, pos from 1, and the fields of each variant."""
    return replies.select(key, F.posexplode(variants(F.col(reply))).alias("pos", "v")).select(key, (F.col("pos") + 1).cast("long").alias("pos"), "v.*")


def image_class(reply: Column) -> Column:
    """Struct of kind, latex and description from a reply; null if it holds no JSON object."""
    def made(x: Column) -> Column:
        kind = F.when(x["kind"].isin(*IMAGE_KINDS), x["kind"]).otherwise("other")
        return F.when(x.isNotNull(), F.struct(kind.alias("kind"), F.coalesce(x["latex"], F.lit("")).alias("latex"), F.coalesce(x["description"], F.lit("")).alias("description")))

    return let(F.from_json(_between(reply, "{", "}"), "struct<kind:string,latex:string,description:string>"), made)


def variant_prompt(qtype: Column, question: Column, options: Column, answer: Column, explanation: Column, count: Column) -> Column:
    """The prompt that asks for variants of a question; image anchors are masked, as the model sees no images."""
    masked = F.regexp_replace(F.coalesce(question, F.lit("")), ANCHOR, "（原题含图片，变式保留图片占位）")
    # The lines of the prompt.
    lines = (
        F.concat(F.lit("题型："), qtype), F.concat(F.lit("题目："), masked),
        F.concat(F.lit("选项："), F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(options, F.array().cast("array<string>")), _quoted), ", "), F.lit("]"))),
        F.concat(F.lit("答案："), F.coalesce(answer, F.lit(""))), F.concat(F.lit("解析："), F.coalesce(explanation, F.lit(""))),
        F.concat(F.lit("请生成 "), count.cast("string"), F.lit(" 道变式题。")),
    )
    return F.concat_ws("\n", *lines)


def _quoted(x: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
