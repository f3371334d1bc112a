"""Documents into the bank: cleaned, read as exams or notes, images bound, written by fingerprint."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qbank.functions import items as I
from qbank.functions import text as T
from qbank.functions.latex import latexize
from qbank.operators import bank as B
from qbank.operators import binding as K
from qbank.operators import layout as L
from qbank.operators import notes as N
from qbank.operators import upsert as U
from qbank.sources.stage import staged

#: What a document says of all its questions, and the default.
GIVEN = {"subject": "默认", "course": "", "source_file": ""}


class Imported(NamedTuple):
    """questions found, in order of seq; the bank with them; (seq, id, outcome) of each; images bound and left over by document."""

    questions: DataFrame
    bank: DataFrame
    outcomes: DataFrame
    counts: DataFrame


def read_documents(docs: DataFrame) -> DataFrame:
    """The questions of docs (doc_id, text, and subject, course, source_file where there are any) in order: pos from 1.

    Entities and private-use characters are decoded and formulas marked; each document is read as I7 says, notes first by
    sections and then by points, numbered notes the other way round. A blank subject is the default one.
    """
    text = latexize(T.fix_private_use(T.html_unescape(F.coalesce("text", F.lit("")))))
    given = [F.coalesce(F.nullif(T.strip(F.col(c)), F.lit("")), F.lit(v)).alias(c) if c in docs.columns else F.lit(v).alias(c) for c, v in GIVEN.items()]
    # As an exploded array of one, so that the text is cleaned once and not again in every expression that reads it, and staged, as
    # each reading takes it from there. What belongs to the document goes along in its key.
    clean = N.route(docs.select(F.struct("doc_id", *given).alias("doc_id"), F.explode(F.array(text)).alias("text")))
    clean = staged(clean.withColumn("doc_id", F.struct("doc_id.*", "sections_first")).drop("sections_first"))
    found = N.parse_routed(clean)
    late = F.when(F.col("reading") == "exam", 0).when((F.col("reading") == "sections") == F.col("doc_id.sections_first"), 1).otherwise(2)
    found = found.select("doc_id.*", late.alias("_late"), *[c for c in found.columns if c != "doc_id"])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("_late", "pos")).cast("long")
    return found.withColumn("pos", place).drop("_late", "sections_first", "reading")


def bind_images(questions: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """questions with the images (doc_id, place, name, key) of their documents, and the counts: by number and in order (C3, C4) where
    a document's images have numbers, else the i-th to the i-th (C5), which counts as neither bound nor left over."""
    bare = images.withColumn("_any", F.max(F.col("key").isNotNull()).over(Window.partitionBy("doc_id"))).where("NOT _any").drop("_any")
    bound = K.bind(questions, images)
    counts = bound.counts.join(bare.select("doc_id").distinct().withColumn("_bare", F.lit(True)), "doc_id", "left")
    return K.zip_images(bound.questions, bare), counts.withColumn("leftover", F.when(F.col("_bare"), 0).otherwise(F.col("leftover")).cast("long")).drop("_bare")


def import_questions(docs: DataFrame, images: DataFrame | None = None, classes: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The questions of docs as they go to the bank, and the counts of images by document (None without images).

    Images are bound, anchors rewritten by class (name, kind, latex; C7), images taken from the stems (G4); of equal stems in a
    document the first stays (G1); damage is marked for review on what the stem has become (H13); then the fingerprint is made
    (H1). seq orders them by document and place.
    """
    found, counts = staged(read_documents(docs).withColumn("pending_review", F.lit(False))), None
    if images is not None:
        found, counts = bind_images(found, images)
    else:
        found = found.withColumn("images", F.array().cast("array<string>"))
    if classes is not None:
        found = L.rewrite_by_class(found, classes, ("doc_id", "pos"))
    found = K.settle(found)
    first = F.row_number().over(Window.partitionBy("doc_id", "question").orderBy("pos"))
    rows = found.withColumn("_n", first).where("_n = 1").drop("_n")
    review = I.needs_review(F.col("question"), F.col("answer"), F.col("options"), F.col("explanation"))
    rows = rows.withColumn("pending_review", F.col("pending_review") | review)
    rows = rows.withColumn("content_hash", T.content_hash(F.col("question"), F.col("answer"), F.col("options")))
    return rows.withColumn("seq", F.expr("cast(doc_id AS decimal(20,0)) * 1000000000 + pos").cast("decimal(38,0)")), counts


def import_documents(bank: DataFrame, docs: DataFrame, images: DataFrame | None = None, classes: DataFrame | None = None) -> Imported:
    """Docs into the bank: questions as import_questions gives them, written as upsert_batch does, in the order of doc_id and
    then of the questions. Rows of docs that share a doc_id count as one document.

    What is read from the documents, and the questions as they go to the bank, are written to the shared folder and read from there.
    """
    rows, counts = import_questions(docs, images, classes)
    rows = staged(rows)
    after, done = U.upsert_batch(bank, rows)
    return Imported(rows, after, done, counts)


def summary(bank: DataFrame, docs: DataFrame) -> DataFrame:
    """D5 of an import without images, by type."""
    return B.import_summary(B.outcomes(bank, import_questions(docs)[0]))
