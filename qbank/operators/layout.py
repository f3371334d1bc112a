"""Images and page layout: attribution, references, clusters and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qbank.functions.text import anchors, latex_ok, strip


def attribute(marks: DataFrame) -> DataFrame:
    """Each image with the question marker before it in (page, y), markers first on ties; null before the first."""
    w = Window.partitionBy("doc").orderBy("page", "y", "kind", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("question", F.last("key", ignorenulls=True).over(w)).where("kind = 1").select("doc", "event_id", "fname", "question")


def references(anchored: DataFrame) -> DataFrame:
    """Names that a question's anchors or image field hold."""
    return anchored.select(F.explode(anchors(F.col("question"))).alias("name")).union(anchored.where("image IS NOT NULL").select("image")).distinct()


def missing_files(anchored: DataFrame, files: DataFrame) -> DataFrame:
    """C8."""
    return references(anchored).join(files, "name", "left_anti")


def orphan_files(anchored: DataFrame, files: DataFrame) -> DataFrame:
    """C9."""
    return files.join(references(anchored), "name", "left_anti")


def image_stats(anchored: DataFrame, files: DataFrame) -> DataFrame:
    """Questions, those with an image field and with an anchor, files missing and files nobody names, and the first 50 of these."""
    own = anchored.agg(
        F.count("*").alias("total"), F.count("image").alias("with_field"), F.count_if(F.size(anchors(F.col("question"))) > 0).alias("with_anchor")
    )
    first = lambda names, name: names.orderBy("name").limit(50).agg(F.array_sort(F.collect_list("name")).alias(name))
    gaps, rest = missing_files(anchored, files), orphan_files(anchored, files)
    counts = own.crossJoin(gaps.agg(F.count("*").alias("missing"))).crossJoin(rest.agg(F.count("*").alias("orphans")))
    return counts.crossJoin(first(gaps, "missing_first")).crossJoin(first(rest, "orphans_first"))  # one row each


def clusters(boxes: DataFrame, gap: float = 25) -> DataFrame:
    """E5: boxes in (y, x) order; a gap to the box before of `gap` and more begins a cluster; small ones go."""
    w = Window.partitionBy("doc").orderBy("y0", "x0", "event_id")
    new = F.coalesce((F.col("y0") - F.lag("y0").over(w) >= gap).cast("int"), F.lit(0))
    out = boxes.withColumn("new", new).withColumn("cluster", F.sum("new").over(w)).groupBy("doc", "cluster").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n")
    )
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return out.where((width >= 8) & (height >= 8) & (width * height >= 400))


def decorative(places: DataFrame, from_paragraphs: int = 5) -> DataFrame:
    """Images of a document that stand in five paragraphs or more."""
    return places.groupBy("doc", "image").agg(F.count_distinct("para").alias("n")).where(F.col("n") >= from_paragraphs)


def kinds_and_errors(classes: DataFrame) -> DataFrame:
    """How often each kind and each error text (blank ones aside) occurs among classified images, in one pass: what, value, n."""
    pairs = F.explode(F.array(F.struct(F.lit("kind").alias("what"), F.col("kind").alias("value")), F.struct(F.lit("error").alias("what"), F.nullif("error", F.lit("")).alias("value"))))
    rows = classes.select(pairs.alias("p")).select("p.*").where("what = 'kind' OR value IS NOT NULL")
    return rows.groupBy("what", "value").agg(F.count("*").alias("n"))


def image_kind(width: Column, height: Column, context: Column) -> Column:
    """H34."""
    shown = F.contains(context, F.lit("如图")) | F.contains(context, F.lit("图像"))
    ratio = F.when(height > 0, width / height).otherwise(0)
    return F.when(shown, "diagram").when((height <= 40) & (width <= 80), "symbol").when((height <= 120) & (ratio >= 3), "formula").otherwise("diagram")


def image_status(mean: Column, deviation: Column) -> Column:
    """H35."""
    return F.when((mean < 5) & (deviation < 8), "black").when(mean >= 128, "kept").otherwise("normalized")


def covers_page(width: Column, height: Column, page_width: Column, page_height: Column, share: float = 0.85) -> Column:
    """At least 85 % of both dimensions."""
    return (width >= share * page_width) & (height >= share * page_height)


def pair_in_order(images: DataFrame, questions: DataFrame) -> DataFrame:
    """The i-th image of a document with its i-th question, by number; what has no partner is left out."""
    nth = lambda *order: F.row_number().over(Window.partitionBy("doc").orderBy(*order))
    asked = questions.withColumn("nth", nth(F.col("key").try_cast("int"), "key")).select("doc", "key", "nth")
    return images.withColumn("nth", nth("event_id")).join(asked, ["doc", "nth"]).select("doc", "key", "fname")


def rewrite_by_class(anchored: DataFrame, classes: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Anchors of formulas as their LaTeX where that is valid, of decoration as nothing; other anchors stay. keys tell rows apart."""
    latex = strip(F.coalesce("latex", F.lit("")))
    new = F.when((F.col("kind") == "formula") & latex_ok(latex), F.concat(F.lit("$"), latex, F.lit("$"))).when(F.col("kind") == "decorative", "")
    swaps = (
        anchored.select(*keys, F.explode(F.array_distinct(anchors(F.col("question")))).alias("name")).join(classes, "name")
        .select(*keys, F.concat(F.lit("【图:"), "name", F.lit("】")).alias("old"), new.alias("new")).where("new IS NOT NULL")
        .groupBy(*keys).agg(F.collect_list(F.struct("old", "new")).alias("swaps"))
    )
    swapped = F.aggregate("swaps", F.col("question"), lambda text, swap: F.replace(text, swap.old, swap.new))
    return anchored.join(swaps, list(keys), "left").withColumn("question", F.coalesce(swapped, "question")).drop("swaps")


def image_context(texts: DataFrame, width: int = 80) -> DataFrame:
    """For each image the start of the first line, by id and place, that holds its anchor."""
    lines = texts.select("id", F.posexplode(F.split("question", "\n")).alias("pos", "line"))
    named = lines.select("id", "pos", F.substring("line", 1, width).alias("head"), F.explode(anchors(F.col("line"))).alias("name"))
    return named.groupBy("name").agg(F.min_by("head", F.struct("id", "pos")).alias("context"))


def image_lists(images: DataFrame) -> DataFrame:
    """The images of each document that stay, are skipped and are normalised, in order."""
    chosen = lambda status: F.array_sort(F.collect_list(F.when(F.col("status") == status, F.col("name"))))
    return images.groupBy("doc").agg(chosen("kept").alias("usable"), chosen("black").alias("skipped"), chosen("normalized").alias("normalized"))
