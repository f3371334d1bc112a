"""Exam papers as text, one document a row, to questions: lines, blocks, items, answer keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qbank.functions import items as I
from qbank.functions.text import let, strip


#: Lines that the fold takes before it hands its rows over: what it copies for a line is bounded by this.
CHUNK = 64


def _split() -> Column:
    text = F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), rf"(?U)({I.PAIR_NUMBER})", "\n$1"), F.lit("\r\n"), F.lit("\n"))
    return F.filter(F.split(text, "\n"), lambda x: ~x.rlike(I.PAGE_HEADER))


def _held(df: DataFrame, *keep: str, **values: Column) -> DataFrame:
    """df with only the columns kept and new values, each computed once: they pass through an array of one that is taken apart, into which Catalyst
    does not pull what is done with them later, not even what a lambda does for each element."""
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))


def doc_lines(docs: DataFrame) -> DataFrame:
    """The lines of each text in order (doc_id, pos, line), paired numbers on lines of their own, page headers left out."""
    return docs.select("doc_id", F.posexplode(_split()).alias("pos", "line"))


# The state after a line: its place, whether a block is open and has an answer, the section and topic, whether a head or number was
# seen; and for each line of a chunk whether it begins a block, and the state there.
_STATE = "'pos', {0}.pos, 'open', {0}.open, 'has', {0}.has, 'section', {0}.section, 'topic', {0}.topic, 'marked', {0}.marked"
_BEGINS = "(e.kind = 'text' AND (e.numbered OR NOT a.open OR (e.pos - a.pos > 1 AND NOT e.option AND (NOT e.answered OR a.has))))"
_SECTION = "CASE e.kind WHEN 'section' THEN e.named WHEN 'topic' THEN NULL WHEN 'head' THEN NULL ELSE a.section END"
_TOPIC = "if(e.kind = 'topic', e.topic, a.topic)"
_MARKED = f"(a.marked OR e.kind IN ('topic', 'section', 'head') OR ({_BEGINS} AND (e.numbered OR e.sub)))"
_STEP = f"""(a, e) -> named_struct('pos', e.pos, 'open', e.kind = 'text', 'has', e.answered OR (NOT {_BEGINS} AND a.has), 'section', {_SECTION}, 'topic', {_TOPIC}, 'marked', {_MARKED},
 'out', concat(a.out, array(named_struct('begins', {_BEGINS}, 'section', {_SECTION}, 'topic', {_TOPIC}, 'marked', {_MARKED}))))"""
_ROW = "array<struct<begins:boolean,section:string,topic:string,marked:boolean>>"
_FOLD = f"""flatten(aggregate(chunks, named_struct('pos', -1, 'open', false, 'has', false, 'section', cast(NULL AS string), 'topic', '', 'marked', false, 'out', cast(array() AS array<{_ROW}>)),
 (s, c) -> aggregate(c, named_struct({_STATE.format('s')}, 'out', cast(array() AS {_ROW})), {_STEP}, a -> named_struct({_STATE.format('a')}, 'out', concat(s.out, array(a.out)))), s -> s.out))"""


def _segmented(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, block, section, topic, lines, qnum, keyed): the blocks of each document, found without a shuffle.

    One fold over the lines of a document that are not blank carries the state; it runs by chunks, so that its cost is linear in
    the lines. A block's lines are then cut out by place. keyed is what the document's answer keys say of its number.
    """
    line = lambda e: e["line"]
    places = _held(docs, "doc_id", all=F.filter(F.transform(_split(), lambda x, i: F.struct(i.alias("pos"), strip(x).alias("line"))), lambda e: e["line"] != ""))

    def features(e: Column) -> Column:
        x = e["line"]
        kind = F.when(x.rlike(I.TOPIC_LINE), "topic").when(x.rlike(I.SECTION_LINE), "section").when(x.rlike(I.NUMBERED_HEAD), "head").when(x.rlike(I.SEPARATOR_LINE), "separator").otherwise("text")
        return F.struct(
            e["pos"].alias("pos"), x.alias("line"), kind.alias("kind"), x.rlike(I.ITEM_START).alias("numbered"), x.rlike(I.OPTION_LINE).alias("option"),
            x.rlike(I.ANSWER_LINE).alias("answered"), x.rlike(I.SUB_ITEM).alias("sub"), I.is_answer_key(x).alias("key"),
            I.type_of_words(F.regexp_extract(x, I.SECTION_LINE, 1), I.SECTION_WORDS).alias("named"), strip(F.regexp_extract(x, I.TOPIC_LINE, 1)).alias("topic"),
        )

    # Of several values for a number in the keys the last one counts.
    r = _held(places, "doc_id", lines=F.transform("all", features))
    entries = F.flatten(F.transform(F.filter("lines", lambda e: e["key"]), lambda e: I.answer_key(line(e))))
    r = _held(
        r, "doc_id", "lines", chunks=F.expr(f"transform(sequence(0, greatest(size(lines) - 1, 0) div {CHUNK}), i -> slice(lines, cast(i AS int) * {CHUNK} + 1, {CHUNK}))"),
        entries=F.array_sort(F.transform(entries, lambda e, i: F.struct(e["qnum"].alias("qnum"), (-i).alias("late"), e["value"].alias("value")))),
    )
    r = _held(
        r, "doc_id", "lines", state=F.expr(_FOLD),
        keys=F.expr("map_from_entries(transform(filter(transform(entries, (e, i) -> struct(e AS e, i = 0 OR entries[greatest(i - 1, 0)].qnum <> e.qnum AS last)), x -> x.last), x -> struct(x.e.qnum, x.e.value)))"),
    )
    r = _held(r, "doc_id", "lines", "state", "keys", first=F.expr("filter(transform(state, (o, i) -> if(o.begins, i, NULL)), i -> i IS NOT NULL)"))
    r = _held(r, "doc_id", "lines", "state", "keys", spans=F.expr("zip_with(first, slice(first, 2, size(first)), (f, e) -> named_struct('f', f, 'n', coalesce(e, size(lines)) - f))"))
    block = """transform(spans, (x, k) -> named_struct('block', k + 1, 'section', state[x.f].section, 'topic', state[x.f].topic, 'marked', state[x.f].marked,
     'lines', filter(slice(lines, x.f + 1, x.n), e -> e.kind = 'text')))"""
    r = r.select("doc_id", "keys", F.explode(F.expr(block)).alias("b")).select("doc_id", "keys", "b.*")
    r = r.where(F.col("marked") | ~I.is_preamble(F.array_join(F.transform("lines", line), " ")))
    r = _held(r, "doc_id", "keys", "block", "section", "topic", "lines", qnum=I.item_number(F.get(F.filter("lines", lambda e: e["numbered"]), F.lit(0))["line"]))
    return r.select("doc_id", F.col("block").cast("long").alias("block"), "section", "topic", "lines", "qnum", F.try_element_at("keys", F.col("qnum")).alias("keyed"))


def blocks(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, block, pos, line, section, topic) of the lines that belong to blocks, one block an item.

    A block begins at an item's number, after a head, topic or separator, and after blank lines unless an option follows, or an
    answer where the block has none yet. Heads set the section, topics the topic, for the blocks after them (E2, E3). Blocks
    before the first head or number that look like a preamble are left out (E6). No shuffle: a document stays in its row.
    """
    return _segmented(docs).select("doc_id", "block", "section", "topic", F.explode("lines").alias("e")).select("doc_id", "block", "e.pos", "e.line", "section", "topic")


_ANSWER_TAG, _EXPLAIN_TAG = r"(?Us)^【\s*答案\s*】\s*(.*)$", r"(?Us)^【\s*(?:解析|详解)\s*】\s*(.*)$"
_INLINE = r"(?Us)^(.*?)答\s*\d{0,3}\s*[：:](.*)$"
_TYPE_LINE, _EXPLAIN_LINE = r"(?Us)^\s*(?:题型|类型)\s*[:：]\s*(.+)$", r"(?Us)^\s*解析\s*[:：]\s*(.*)$"


def _part(e: Column) -> Column:
    """What a line of a block can be taken for, and its values."""
    x, options = e["line"], I.split_options(e["line"])
    role = (
        F.when(options.isNotNull(), "options").when(x.rlike(_TYPE_LINE), "type").when(x.rlike(I.ANSWER_LINE), "answer")
        .when(x.rlike(_EXPLAIN_LINE), "explanation").when(x.rlike(I.OPTION_LINE), "option").when(x.rlike(I.JUDGE_OPTIONS), "judge").otherwise("stem")
    )
    tag = F.when(x.rlike(_ANSWER_TAG), "tagged").when(x.rlike(_EXPLAIN_TAG), "explained")
    return F.struct(
        x.alias("line"), role.alias("role"), tag.alias("tag"), x.rlike(_INLINE).alias("inline"), F.coalesce(options, F.array(x)).alias("options"),
        F.when(tag == "tagged", strip(F.regexp_extract(x, _ANSWER_TAG, 1))).when(tag == "explained", strip(F.regexp_extract(x, _EXPLAIN_TAG, 1))).alias("tagged"),
        strip(F.regexp_extract(x, _INLINE, 1)).alias("asked"), strip(F.regexp_extract(x, _INLINE, 2)).alias("told"),
        F.when(role == "type", F.regexp_extract(x, _TYPE_LINE, 1)).when(role == "answer", F.regexp_extract(x, I.ANSWER_LINE, 1))
        .when(role == "explanation", F.regexp_extract(x, _EXPLAIN_LINE, 1)).alias("value"),
        x.rlike(I.JUDGE_OPTIONS).alias("judge"), x.rlike(rf"(?U)^\s*{I.PAIR_NUMBER}").alias("paired"),
    )


def _stem(x: Column) -> Column:
    bare = strip(F.regexp_replace(x, I.ITEM_START, ""))

    def marked(b: Column) -> Column:
        mark = F.regexp_extract(b, I.TYPE_MARK, 1)
        named = I.type_of_words(mark).isNotNull()
        return F.struct(F.when(named, mark).alias("type"), F.when(named, strip(F.regexp_replace(b, I.TYPE_MARK, ""))).otherwise(b).alias("stem"))

    return let(bare, marked)


def items(docs: DataFrame) -> DataFrame:
    """One row for each block that is a question: doc_id, block, qnum, topic, qtype, question, options, answer, explanation, keyed.

    Up to a tag for answer or explanation, the lines of a block are taken each for itself until one holds an answer within
    itself; from there on all lines are the answer, and after a tag all are explanation. A block without a stem, a lone option, and
    notes that have neither options, answer, a blank to fill in nor a plain type give none. At most eight options count; lines of
    options after them belong to the stem. qnum is the number at the head, keyed what the answer keys have for it.
    """
    own = ("doc_id", "block", "section", "topic", "qnum", "keyed")
    b = _held(_segmented(docs), *own, x=F.transform(F.filter("lines", lambda e: ~e["key"]), _part))
    first = lambda c, test: F.array_position(F.transform(c, test), F.lit(True)).cast("int")  # noqa: E731  from 1, 0 for none
    upto = lambda c, n: F.slice(c, F.lit(1), n)
    after = lambda c, n: F.slice(c, n + 1, F.size(c))
    size = lambda n, c: F.when(n == 0, F.size(c)).otherwise(n - 1)
    b = _held(b, *own, "x", n=size(first("x", lambda e: e["tag"].isNotNull()), F.col("x")))
    b = _held(b, *own, head=upto("x", F.col("n")), tail=after("x", F.col("n")))
    b = _held(b, *own, "head", "tail", inline=first("head", lambda e: e["inline"]), given=first("head", lambda e: (e["role"] == "answer") & (e["value"] != "")))
    takes = (F.col("inline") > 0) & ((F.col("given") == 0) | (F.col("given") >= F.col("inline")))
    b = _held(b, *own, "head", "tail", m=F.when(takes, F.col("inline") - 1).otherwise(F.size("head")))
    b = _held(b, *own, "tail", plain=upto("head", F.col("m")), told=after("head", F.col("m")))
    b = _held(b, *own, "tail", "plain", "told", u=first("told", lambda e: ~(e["inline"] & (e["told"] == ""))))
    t = F.when(F.col("u") == 0, F.size("told")).when(F.get("told", F.col("u") - 1)["inline"], F.col("u")).otherwise(F.col("u") - 1)
    full = """aggregate(plain, named_struct('n', 0, 'i', 0, 'at', cast(NULL AS int)), (a, e) -> named_struct('n', a.n + CASE e.role WHEN 'options' THEN size(e.options) WHEN 'option' THEN 1 ELSE 0 END,
     'i', a.i + 1, 'at', coalesce(a.at, if(a.n >= 8, a.i, NULL))), a -> coalesce(a.at, a.i))"""
    b = _held(b, *own, "tail", "plain", "told", t=t, full=F.expr(full))
    roled = F.transform("plain", lambda e, i: F.struct(F.when((e["role"] == "option") & (i >= F.col("full")), F.when(e["judge"], "judge").otherwise("stem")).otherwise(e["role"]).alias("role"), e.alias("e")))
    b = _held(b, *own, "tail", plain=roled, takes=upto("told", F.col("t")), continued=after("told", F.col("t")))
    of = lambda *roles: F.filter("plain", lambda e: e["role"].isin(*roles))
    values = lambda role: F.transform(of(role), lambda e: e["e"]["value"])
    last = lambda c: F.get(c, F.size(c) - 1)
    not_empty = lambda c: F.filter(c, lambda v: v != "")
    stems = F.transform(F.concat(F.transform(of("stem"), lambda e: e["e"]["line"]), F.transform("takes", lambda e: e["asked"])), _stem)
    tagged = F.transform(F.filter("tail", lambda e: e["tag"].eqNullSafe("tagged")), lambda e: e["tagged"])
    explained = F.transform(F.filter("tail", lambda e: ~e["tag"].eqNullSafe("tagged")), lambda e: F.coalesce(e["tagged"], e["line"]))
    told = F.array_join(not_empty(F.concat(F.transform("takes", lambda e: e["told"]), F.transform("continued", lambda e: e["line"]))), "\n")
    b = _held(
        b, *own, stems=stems, raw=F.slice(F.flatten(F.transform(of("options", "option"), lambda e: e["e"]["options"])), 1, 8),
        given=F.coalesce(last(tagged), F.when(F.size("takes") > 0, told), last(values("answer")), F.lit("")),
        explanation=F.array_join(not_empty(F.concat(F.slice(F.reverse(values("explanation")), 1, 1), explained)), "\n"),
        named=last(values("type")), judged=F.size(of("judge")) > 0, paired=F.exists(of("stem"), lambda e: e["e"]["paired"]),
    )
    types = F.array_compact(F.transform("stems", lambda s: s["type"]))
    b = _held(
        b, *own, "raw", "given", "explanation", "judged", "paired", stem=strip(F.array_join(not_empty(F.transform("stems", lambda s: s["stem"])), " ")),
        type=F.coalesce("named", F.get(types, F.lit(0)), F.lit("")),
    )
    question = F.when((F.col("stem") == "") & (F.size("raw") > 1), F.array_join("raw", " ")).otherwise(F.col("stem"))
    b = _held(b.where((F.col("stem") != "") | (F.size("raw") > 1)), *own, "raw", "given", "explanation", "judged", "paired", "type", question=question)
    kept = (*own, "raw", "given", "explanation", "judged", "paired", "question")
    b = _held(b, *kept, kind=I.detect_qtype(F.col("type"), F.size("raw"), F.col("question"), F.col("section")))
    several = (F.col("kind") == "single_choice") & (F.regexp_count("given", F.lit("[A-Za-z]")) >= 2)
    b = _held(b, *kept, kind=F.when(several, "multiple_choice").otherwise(F.col("kind")))
    b = _held(b, *kept, "kind", answer=I.clean_answer(F.col("given"), F.col("kind")), options=F.transform("raw", lambda o: strip(F.regexp_replace(o, I.OPTION_PREFIX, ""))))
    b = b.withColumn("qtype", F.when(F.col("answer").isin("对", "错") | F.col("judged"), "judge").otherwise(F.col("kind")))
    q = F.col("question")
    filled = (F.col("section") == "blank") & (q.rlike(I.MATH_SYMBOL) | q.rlike("[=＝求设若当已知满足使得则试]"))
    explicit = (
        F.col("paired") | (F.size("options") >= 2) | (F.col("answer") != "") | F.col("qtype").isin("single_choice", "multiple_choice", "judge", "essay", "calc")
        | (I.has_blank_mark(q) & (F.length(q) <= 120)) | F.coalesce(filled, F.lit(False))
    )
    return b.where((F.length(q) >= 3) & ~q.rlike(I.JUDGE_OPTIONS) & explicit).select("doc_id", "block", "qnum", "topic", "qtype", "question", "options", "answer", "explanation", "keyed")


def backfill_answers(found: DataFrame) -> DataFrame:
    """What the key has for questions without an answer; several letters make a single choice a multiple one."""
    fill = (F.col("answer") == "") & F.col("keyed").isNotNull()
    out = _held(found, *[c for c in found.columns if c not in ("answer", "keyed")], fill=fill, answer=F.when(fill, I.clean_answer(F.col("keyed"), F.col("qtype"))).otherwise(F.col("answer")))
    several = F.col("fill") & (F.col("qtype") == "single_choice") & (F.regexp_count("answer", F.lit("[A-Za-z]")) >= 2)
    return out.withColumn("qtype", F.when(several, "multiple_choice").otherwise(F.col("qtype"))).drop("fill")


def parse_exam(docs: DataFrame) -> DataFrame:
    """I4: the questions of each document in order: doc_id, pos (from 1), qnum, topic, qtype, question, options, answer, explanation,
    pending_review. Rows of docs that share a doc_id count as one document: their questions are numbered together."""
    # Dealt by document before the texts are read, as the last step needs that: the only shuffle. With the number of parts, so that
    # texts, which are short for the work that they make, are not put together again.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = backfill_answers(items(docs.repartition(parts, "doc_id")))
    review: Column = I.needs_review(F.col("question"), F.col("answer"), F.col("options"), F.col("explanation"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("block")).cast("long")
    return out.select("doc_id", place.alias("pos"), "qnum", "topic", "qtype", "question", "options", "answer", "explanation", review.alias("pending_review"))
