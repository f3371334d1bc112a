"""Study notes to questions, and which reading a document gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qbank.functions import items as I
from qbank.functions.text import strip
from qbank.operators import exams

# Marks of a note's title, beginnings that make it a question already, and words of notes.
TITLE_MARKS = ("单选", "名词解释", "简答", "论述")
ASKING = ("简述", "论述", "如何", "为什么", "什么是", "名词解释")
NOTE_WORDS = ("知识点", "考点", "名词解释", "复习笔记", "笔记")
LONGEST_FACT = 120
SECTION_HEAD = rf"(?Us)^(?:第[{I.NUMERALS}]+节|导论)[、\s]*(.*)$"
CHAPTER_HEAD = rf"^第[{I.NUMERALS}]+章"
ENTRY = r"(?U)^\d{1,3}[、.．]\s*(.{1,60})$"
FACTS = "^单选(?:题)?[：:]?$"

_COLUMNS = ("doc_id", "pos", "qtype", "question", "answer", "explanation", "pending_review")


def note_title(title: Column) -> Column:
    """Struct of a note's title without its marks, and the mark."""
    bracket, paren = "【([^】]{1,12})】", "[（(]([^）)]{0,12})[）)]"
    bare = F.regexp_replace(title, bracket, "")
    inner = F.regexp_extract(bare, paren, 1)
    marked = inner.rlike("|".join(TITLE_MARKS))
    mark = F.coalesce(F.nullif(F.regexp_extract(title, bracket, 1), F.lit("")), F.when(marked, inner), F.lit(""))
    return F.struct(strip(F.when(marked, F.regexp_replace(bare, paren, "")).otherwise(bare)).alias("title"), mark.alias("mark"))


def essay_question(title: Column) -> Column:
    """The question that a title asks."""
    return F.when(title.rlike(f"^(?:{'|'.join(ASKING)})"), title).otherwise(F.concat(F.lit("简述"), title, F.lit("。")))


def _lines(docs: DataFrame) -> DataFrame:
    """Lines that are neither blank nor separators."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]", "\n")
    r = docs.select("doc_id", F.posexplode(F.transform(F.split(text, "\n"), strip)).alias("pos", "line"))
    return r.where((F.col("line") != "") & ~F.col("line").rlike(I.SEPARATOR_LINE))


def _parts(lines: DataFrame, kind: Column) -> DataFrame:
    """Each line with the number and kind of the last line that has a kind; lines before the first are left out."""
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    r = lines.withColumn("kind", kind)
    return r.select("*", F.last(F.when(F.col("kind").isNotNull(), F.struct("pos", "kind")), ignorenulls=True).over(so_far).alias("part")).where("part is not null")


def _finished(rows: DataFrame) -> DataFrame:
    """Rows with their review flag and their place in the document."""
    review = I.needs_review(F.col("question"), F.col("answer"), F.array().cast("array<string>"), F.col("explanation"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("late", "pos")).cast("long")
    return rows.select("doc_id", place.alias("pos"), "qtype", "question", "answer", "explanation", review.alias("pending_review")).select(*_COLUMNS)


def note_points(docs: DataFrame) -> DataFrame:
    """Numbered notes as questions, and after them the facts listed under a heading for single choice, as true statements.

    A note marked as a term asks for its meaning, one marked as single choice is a true statement, all others are essays on their
    title. Facts of more than 120 characters are left out.
    """
    line = F.col("line")
    kind = F.when(line.rlike(FACTS), "facts").when(line.rlike(ENTRY), "entry")
    fact_lines = (F.col("part.kind") == "facts") & F.col("kind").isNull() & (F.length("line") <= LONGEST_FACT)
    r = _parts(_lines(docs), kind).where((F.col("part.kind") == "entry") | fact_lines)
    # An entry with its lines is one group, a fact is a group of its own.
    late = F.when(F.col("part.kind") == "facts", 1).otherwise(0).alias("late")
    groups = r.groupBy("doc_id", late, F.when(F.col("part.kind") == "facts", F.col("pos")).otherwise(F.col("part.pos")).alias("at")).agg(
        F.min_by("line", "pos").alias("head"), F.array_sort(F.collect_list(F.when(F.col("kind").isNull(), F.struct("pos", "line")))).alias("body")
    )
    listed = F.col("late") == 1
    groups = groups.select(
        "doc_id", "late", F.col("at").alias("pos"), "head", note_title(F.regexp_extract("head", ENTRY, 1)).alias("t"), F.array_join(F.transform("body", lambda b: b["line"]), "\n").alias("body")
    ).where(listed | (F.col("t.title") != ""))
    term, fact = F.contains("t.mark", F.lit("名词解释")), F.contains("t.mark", F.lit("单选"))
    title = F.col("t.title")
    return _finished(groups.select(
        "doc_id", "late", "pos", F.when(listed, "judge").when(term, "thinking").when(fact, "judge").otherwise("essay").alias("qtype"),
        F.when(listed, F.col("head")).when(term, F.concat(F.lit("名词解释："), title)).when(fact, title).otherwise(essay_question(title)).alias("question"),
        F.when(listed | (~term & fact), "对").otherwise(F.col("body")).alias("answer"), F.when(~listed & ~term & fact, F.col("body")).otherwise("").alias("explanation"),
    ))


def note_sections(docs: DataFrame) -> DataFrame:
    """Each section with a title and a body as one essay; a chapter's head ends the section before it."""
    line = F.col("line")
    r = _parts(_lines(docs), F.when(line.rlike(CHAPTER_HEAD), "chapter").when(line.rlike(SECTION_HEAD), "section")).where("part.kind = 'section'")
    sections = r.groupBy("doc_id", F.col("part.pos").alias("pos")).agg(
        strip(F.regexp_extract(F.min_by("line", "pos"), SECTION_HEAD, 1)).alias("title"), F.array_sort(F.collect_list(F.when(F.col("kind").isNull(), F.struct("pos", "line")))).alias("body")
    ).where("title <> '' AND size(body) > 0")
    return _finished(sections.select(
        "doc_id", F.lit(0).alias("late"), "pos", F.lit("essay").alias("qtype"), essay_question(F.col("title")).alias("question"),
        F.array_join(F.transform("body", lambda b: b["line"]), "\n").alias("answer"), F.lit("").alias("explanation"),
    ))


def route(docs: DataFrame) -> DataFrame:
    """Docs with as_exam, as_points and as_sections: which readings each document gets, and whether sections come before points.

    One with sections, few answers and no sign of an exam is notes; one with section heads or options is an exam; one with
    numbered entries and words of notes is numbered notes; all others are read as exams, and by sections where they have some.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    sections, points = t.rlike(rf"(?Um)^\s*(第[{I.NUMERALS}]+节|导论)"), t.rlike(r"(?Um)^\s*\d{1,3}[、．]")
    exam = t.rlike(rf"(?Um)^\s*[{I.NUMERALS}]+、\s*[（(]?\s*({'|'.join(w for w in I.SECTION_WORDS if w != '选择')})题?") | t.rlike(r"(?Um)^\s*[A-Ha-h]\s*[.．、)]\s*\S")
    notes = sections & (F.regexp_count(t, F.lit(r"(?Um)^\s*答案\s*[:：]")) < 20) & ~exam
    numbered = ~notes & ~exam & points & t.rlike("|".join(NOTE_WORDS))
    return docs.select(
        "*", (~notes & ~numbered).alias("as_exam"), (points & (notes | numbered)).alias("as_points"), (sections & ~exam).alias("as_sections"),
        notes.alias("sections_first"),
    )


def parse_documents(docs: DataFrame) -> DataFrame:
    """The questions of each document by the readings it gets (G6): doc_id, reading, pos, and the columns of a question."""
    return parse_routed(route(docs))


def parse_routed(routed: DataFrame) -> DataFrame:
    """parse_documents of what route gave; doc_id may be any key, a struct too."""
    empty = {"qnum": F.lit(None).cast("int"), "topic": F.lit(""), "options": F.array().cast("array<string>")}
    readings = (("exam", "as_exam", exams.parse_exam), ("points", "as_points", note_points), ("sections", "as_sections", note_sections))
    out = [parse(routed.where(flag)).withColumn("reading", F.lit(name)) for name, flag, parse in readings]
    return out[0].unionByName(out[1].withColumns(empty)).unionByName(out[2].withColumns(empty))
