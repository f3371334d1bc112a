"""Queries of the operators that turn exam papers, notes and stored replies into rows, with what they give by construction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qbank.functions import answers as A
from qbank.functions import items as I
from qbank.functions import latex as X
from qbank.functions import replies as R
from qbank.functions import text as T
from qbank.operators import exams as E
from qbank.operators import notes as N
from qbank.plans import papers as P
from qbank.plans.fixtures import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str, query: Query) -> None:
    QUERIES[name], SQL[name] = query, with_views(f"SELECT * FROM ({sql})")


def _cases(name: str, fn: Callable[..., Column], cases: list[tuple]) -> None:
    """A query of a rule over one input for each document: the case of the document's number, with words from its text.

    Each case gives the rule's inputs and, last, its result.
    """
    inputs = [P.by_layout([P._value(case[j]) for case in cases]) for j in range(len(cases[0]) - 1)]
    given = "SELECT doc_id, " + ", ".join(f"{sql} AS x{j}" for j, sql in enumerate(inputs)) + " FROM documents"

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        view(spark, sf_dir, "papers")  # registers the tables
        return spark.sql(given).select("doc_id", fn(*[F.col(f"x{j}") for j in range(len(inputs))]).alias("result"))

    _add(name, f"SELECT doc_id, {P.by_layout([P._value(case[-1]) for case in cases])} AS result FROM documents", query)


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "papers")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.blocks(_papers(spark, sf_dir))


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("options", F.array_join("options", "|"))


_PAIR = r"(【\s*\d{1,3}\s*[-－—]\s*\d{1,3}\s*】)"
_add(
    "I1_doc_lines",
    rf"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, md5(line) AS line_md5 FROM (
 SELECT doc_id, i, list_extract(l, i) AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
  SELECT doc_id, string_split(replace(regexp_replace(text, '{_PAIR}', concat(chr(10), '\1'), 'g'), concat(chr(13), chr(10)), chr(10)), chr(10)) AS l
  FROM (SELECT doc_id, concat(p.text, chr(10), n.text) AS text FROM papers p JOIN noisy n USING (doc_id)))))
 WHERE NOT regexp_matches(line, '^\s*第\s*\d+\s*页\s*/\s*共\s*\d+\s*页\s*$')""",
    lambda s, d: E.doc_lines(
        view(s, d, "papers").join(view(s, d, "noisy").withColumnRenamed("text", "t"), "doc_id").select("doc_id", F.concat_ws("\n", "text", "t").alias("text"))
    ).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("line").alias("line_md5")),
)
_add(
    "I2_segment_blocks", f"SELECT * EXCLUDE (nth) FROM ({P.blocks_sql()})",
    lambda s, d: _blocks(s, d).groupBy("doc_id", "block").agg(
        F.count("*").alias("n_lines"), F.min_by("line", "pos").alias("first_line"), F.first("section").alias("section"), F.first("topic").alias("topic")
    ),
)
_add(
    "I3_block_to_question", f"SELECT doc_id, block, topic, qtype, question, options, given AS answer, explanation FROM ({P.items_sql()})",
    lambda s, d: _joined(E.items(_papers(s, d)).drop("qnum", "keyed")),
)
_add(
    "I4_parse_exam",
    f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block) AS pos, coalesce(qnum, 0)::BIGINT AS qnum, topic, qtype, question, options, answer, explanation, pending_review
 FROM ({P.items_sql()})""",
    lambda s, d: _joined(E.parse_exam(_papers(s, d))).withColumn("qnum", F.coalesce("qnum", F.lit(0)).cast("long")),
)
_add(
    "C2_answer_key_backfill", f"SELECT doc_id, qnum, qtype, question, answer FROM ({P.items_sql()}) WHERE given = '' AND answer <> ''",
    lambda s, d: E.backfill_answers(E.items(_papers(s, d)).where("answer = ''")).where("answer <> ''").select("doc_id", "qnum", "qtype", "question", "answer"),
)
_add(
    "E6_before_first_marker", f"SELECT doc_id, min(block) AS first_block FROM ({P.blocks_sql()}) GROUP BY doc_id",
    lambda s, d: _blocks(s, d).groupBy("doc_id").agg(F.min("block").alias("first_block")),
)

_cases("H13_mark_pending", lambda q, a: I.needs_review(q, a, F.array().cast("array<string>"), F.lit("")), [
    ("{1} <Formula 3> {5}", "{9}", True), ("{1} 与 {5}", "{9} <imgref>", True), ("电磁矢量 $s \\rh o$ {1}", "", True), ("求 $\\sin x + \\cos x$ 的值 {1}", "", False),
    ("已知 ( ) ω j F t f ↔ ，求频谱 {1}", "", True), ("动摩擦因数为 、夹角为 ，重力加速度为 {1}", "", True), ("{1}（ ）", "A", True),
    ("{1} {5} {9} {13}（ ）", "A", False), ("∫ {1} {5} {9}", "{1}", False), ("∫ {1} {5} {9}", "", True), ("$x {1} {5} ∫ {9}", "{1}", True),
])
_cases("H24_clean_answer", I.clean_answer, [
    (" 1,2,3 ", "multiple_choice", "123"), ("b、a，B", "multiple_choice", "AB"), ("（c）", "single_choice", "C"), ("【{1}】", "single_choice", "W"),
    ("√", "judge", "对"), ("A", "judge", "A"), ("正确的 {1}", "judge", "对"), ("（错误）", "judge", "错"), ("X", "judge", "错"), ("（{1}）", "blank", "{1}"),
    ("(0,{1}]", "calc", "(0,{1}]"), ("  {1} {5} ", "essay", "{1} {5}"),
])
_cases("H25_detect_qtype", lambda t, n, q, s: I.detect_qtype(t, n, q, s), [
    ("不定项选择题", 0, "{1}", None, "multiple_choice"), ("", 0, "【多项选择题】{1}", None, "multiple_choice"), ("", 0, "【 判断 】{1}", None, "judge"), ("", 4, "{1}", None, "single_choice"),
    ("", 4, "{1}", "multiple_choice", "multiple_choice"), ("", 1, "{1}", "essay", "essay"), ("", 0, "判断 {1} 是否成立", None, "judge"), ("", 0, "{1} 为（ ）", None, "blank"),
    ("", 0, "{1} = ", None, "blank"), ("", 0, "设 {1}，画出波形", None, "calc"), ("", 0, "已知 {1}，求 {5}", None, "calc"), ("", 0, "比较 {1} 与 {5}", None, "essay"),
    ("", 0, "请按要求完成 {1}", None, "blank"),
])
_cases("H26_blank_mark", I.has_blank_mark, [
    ("{1} ____ {5}", True), ("求 $x_{1}$ 的值", False), ("{1}（ ）", True), ("\\(x_{1}\\) 与 {5}", False), ("{1} ＿", True), ("{1}（{5}）", False), ("{1}( )", True),
])
_cases("H27_split_options", lambda x: F.coalesce(F.array_join(I.split_options(x), "|"), F.lit("-")), [
    ("A. {1} B. {5}", "{1}|{5}"), ("（A） {1}（B）{5} （C）{9}", "{1}|{5}|{9}"), ("{1} A. {5} B. {9}", "-"), ("A. {1}", "-"), ("A、{1} b){5}", "{1}|{5}"), ("A. B. ", "-"), ("", "-"),
])
_cases("H28_answer_key_line", lambda x: F.concat(I.is_answer_key(x).cast("string"), F.array_join(F.transform(I.answer_key(x), lambda e: F.concat(F.lit("|"), e["qnum"].cast("string"), F.lit("="), e["value"])), "")), [
    ("答案：1.A 2.bc", "true|1=A|2=BC"), ("参考答案 12.-1 13.18", "true|12=-1|13=18"), ("1.A 2.B", "true|1=A|2=B"), ("3 5", "false|3=5"), ("答案：1.√2，2.1/2", "true|1=√2|2=1/2"),
    ("", "false"), ("解：甲", "false"), ("1.A，2", "false|1=A"),
])
_cases("H29_qnum", lambda x: F.coalesce(I.item_number(x), F.lit(-1)).cast("int"), [
    ("12. {1}", 12), ("第 5 题 {1}", 5), ("【4-7】{1}", 4), ("问：{1}", -1), ("问3：{1}", 3), ("{1} 1.", -1), ("  7）{1}", 7), ("1234. {1}", -1),
])

_cases("H4_unicode_to_latex", X.unicode_to_latex, [
    ("{1} ≤ {5}", "{1} \\leq {5}"), ("(a+b)/(c)", "\\frac{a+b}{c}"), ("1/2", "\\frac{{1}}{{2}}"), ("x^2", "x^{{2}}"), ("x_10", "x_{{10}}"), ("√2", "\\sqrt2"), ("½ α", "\\frac{{1}}{{2}} \\alpha "),
    ("lim(x→0)", "\\lim_{x\\rightarrow0}"), ("limit lim", "limit \\lim"), ("sum(i=1,n)", "\\sum_{i=1}^{n}"), ("int(0,1)", "\\int_{0,1}"), ("[1 2]", "\\begin{pmatrix}1 2\\end{pmatrix}"), ("x²", "x^{{2}}"),
])
_cases("H5_latexize_segments", X.latexize, [
    ("已知 |z|>3 且 A & B", "已知 $|z|>3$ 且 A & B"), ("计算 ∫x dx 的值", "计算 $\\int x dx$ 的值"), ("已知 $F(z)=\\frac{z}{z-3}$，求 |z|>3", "已知 $F(z)=\\frac{z}{z-3}$，求 $|z|>3$"),
    ("【图:img.png】如图，v=√2", "【图:img.png】如图，$v=\\sqrt 2$"), ("{1} {5}", "{1} {5}"), ("【1-2】{1}", "【1-2】{1}"), ("设{1}=3，求", "设${1}=3$，求"), ("", ""), ("∞", "$\\infty$"),
])
_cases("H6_smart_formula", X.smart_formula, [
    ("{1} &lt; {5}", "{1} < {5}"), ("{1} &le; π", "${1} \\leq \\pi $"), ("{1}", "{1}"), ("x_1 &amp;gt; 2", "x_{{1}} > 2"), ("√{1}", "$\\sqrt{1}$"),
])
_cases("H33_merge_scripts", lambda x: F.array_join(X.merge_scripts(F.split(x, "[|]")), "|"), [
    ("{1}|$^{-}$|$^{{11}}$|{5}", "{1}|$^{-11}$|{5}"), ("$_{a}$|$_{b}$|$_{c}$", "$_{abc}$"), ("$^{a}$|$_{b}$", "$^{a}$|$_{b}$"), ("{1}", "{1}"), ("$^{a}$|{1}|$^{b}$", "$^{a}$|{1}|$^{b}$"),
])
_cases("H30_note_title", lambda x: (lambda t: F.concat_ws("|", t["title"], t["mark"], N.essay_question(t["title"])))(N.note_title(x)), [
    ("{1}【名词解释】", "{1}|名词解释|简述{1}。"), ("如何{1}（简答）", "如何{1}|简答|如何{1}"), ("{1}（{5}）", "{1}（{5}）||简述{1}（{5}）。"), ("【论述】{1}(单选)", "{1}|论述|简述{1}。"), ("什么是 {1} ", "什么是 {1}||什么是 {1}"),
])
_cases("H31_variants_parse", lambda x: F.coalesce(F.array_join(F.transform(R.variants(x), lambda v: F.concat_ws("|", v["question"], F.array_join(v["options"], ","), v["correct_answer"])), ";"), F.lit("-")), [
    ('[{"question": " {1} ", "options": ["A. {5}", " "], "correct_answer": "A"}]', "{1}|A. {5}|A"),
    ('```json\n[{"question": "{1}"}, {"question": ""}, {"question": "{5}", "correct_answer": "{9}"}]\n```', "{1}||;{5}||{9}"), ("{1}", "-"), ("[{1}", "-"), ("[{1}]", "-"), ("x [] y", ""),
    ("[" + ", ".join('{"question": "{1}"}' for _ in range(12)) + "]", ";".join(["{1}||"] * 10)),
])
_cases("H32_vision_parse", lambda x: F.coalesce((lambda c: F.concat_ws("|", c["kind"], c["latex"], c["description"]))(R.image_class(x)), F.lit("-")), [
    ('ok {"kind": "formula", "latex": "{1}", "description": "{5}"}', "formula|{1}|{5}"), ('{"kind": "{1}"}', "other||"), ('{"latex": "{1}"} end', "other|{1}|"),
])
_cases("H37_prompt_rows", lambda q, o, a: R.variant_prompt(F.lit("calc"), q, F.split(o, "[|]"), a, F.lit(""), F.lit(3)), [
    ("{1} 【图:a.png】", 'A. {5}|B. "{9}"', "A", '题型：calc\n题目：{1} （原题含图片，变式保留图片占位）\n选项：["A. {5}", "B. \\"{9}\\""]\n答案：A\n解析：\n请生成 3 道变式题。'),
    ("{1}", "{5}", "{9}", '题型：calc\n题目：{1}\n选项：["{5}"]\n答案：{9}\n解析：\n请生成 3 道变式题。'),
])

_cases("H14_latex_ok", T.latex_ok, [
    ("\\frac{a}{b}{1}", True), ("{", False), ("a$ {1}", False), ("\\begin{x}", False), ("\\rhoé", True), ("\\fooé {1}", False), (" ", False), ("{1}", True),
])
_cases("H19_check_judge", lambda x, o: A.judge_value(x, F.split(o, "[|]")), [
    (" √ ", "", "对"), ("A", "A. 错|B. 对", "错"), ("b", "A. 错误|B. 正确", "对"), ("C", "A. 错|B. 对", "C"), ("A", "A. {1}|B. 对", "A"), ("{1}", "", "{1}"), ("FALSE", "", "错"),
])
_cases("H20_check_calc_forms", lambda u, r: A.near(A.numbers(u), A.numbers(r)), [
    ("8", "2^3", True), ("6.2832", "2*pi", True), ("6.2832", "2π", True), ("1.4142", "sqrt(2)", True), ("0.5", "\\frac{a}{b}", False), ("0.25", "\\frac{{1}}{{4}}", True), ("1", "1/0", False),
    ("7", "2^3", False), ("1.5708", "π/2", True), ("2.4495", "√2*√3", True),
])

_NOTE = ("doc_id", "pos", "qtype", "question", "answer", "explanation")
for _name, _reading, _parse in (("I5_parse_note_points", "points", N.note_points), ("I6_parse_note_sections", "sections", N.note_sections)):
    _add(
        _name, f"SELECT {', '.join(_NOTE)} FROM ({P.notes_sql()}) WHERE reading = '{_reading}'",
        lambda s, d, parse=_parse, flag=f"as_{_reading}": parse(N.route(view(s, d, "notes")).where(flag)).select(*_NOTE),
    )
_add("I7_route_mode", f"SELECT doc_id, as_exam, as_points, as_sections FROM ({P.readings_sql()})", lambda s, d: N.route(view(s, d, "notes")).drop("text", "sections_first"))

# Whole documents as exams: which block, section and topic each of their lines gets, as windows over the lines say it.
_SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0]"
_FLAGS = {
    "topic": rf"^{_SPACE}*知识点{_SPACE}*[:：]", "section": f"^[{I.NUMERALS}]+、{_SPACE}*[（(]?{_SPACE}*({'|'.join(I.SECTION_WORDS)})", "head": rf"^{_SPACE}*[{I.NUMERALS}]+{_SPACE}*[、.．]{_SPACE}*\S",
    "separator": "^[-=—]{5,}$", "numbered": rf"^{_SPACE}*(第{_SPACE}*\d+{_SPACE}*题|问{_SPACE}*\d{{0,3}}{_SPACE}*[:：]|【{_SPACE}*\d{{1,3}}{_SPACE}*[-－—]{_SPACE}*\d{{1,3}}{_SPACE}*】|\d{{1,3}}{_SPACE}*[.．、)）：:])",
    "option": rf"^{_SPACE}*[（(]?{_SPACE}*[A-Ha-h]{_SPACE}*([.．、)）]|{_SPACE})", "answered": rf"^{_SPACE}*(\[?【?)?{_SPACE}*(答案|参考答案)", "sub": rf"^{_SPACE}*[（(]{_SPACE}*\d{{1,3}}{_SPACE}*[）)]",
}
_flag = lambda name: f"regexp_matches(line, '{_FLAGS[name]}')"
_add(
    "I2_document_blocks",
    rf"""WITH x AS (SELECT doc_id, list_filter(string_split(replace(regexp_replace(coalesce(text, ''), '{_PAIR}', concat(chr(10), '\1'), 'g'), concat(chr(13), chr(10)), chr(10)), chr(10)),
  lambda l: NOT regexp_matches(l, '^\s*第\s*\d+\s*页\s*/\s*共\s*\d+\s*页\s*$')) AS l FROM documents),
n AS (SELECT doc_id, i - 1 AS pos, regexp_replace(list_extract(l, i), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM x)),
f AS (SELECT *, NOT ({_flag('topic')} OR {_flag('section')} OR {_flag('head')} OR {_flag('separator')}) AS plain, {_flag('numbered')} AS numbered, {_flag('option')} AS option, {_flag('answered')} AS answered FROM n WHERE line <> ''),
g AS (SELECT *, coalesce(pos - lag(pos) OVER w > 1, false) AS gap, coalesce(lag(plain) OVER w, false) AS open FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
h AS (SELECT *, plain AND (numbered OR NOT open OR (gap AND NOT option AND NOT answered)) AS hard FROM g),
p AS (SELECT *, sum(hard::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM h),
a AS (SELECT *, coalesce(sum((plain AND answered)::INT) OVER (PARTITION BY doc_id, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
b AS (SELECT *, sum((hard OR (plain AND gap AND answered AND NOT option AND before > 0))::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM a)
SELECT doc_id, pos::BIGINT AS pos, block::BIGINT AS block, md5(line) AS line_md5, coalesce(NULL, '') AS topic FROM b WHERE plain""",
    lambda s, d: E.blocks(view(s, d, "documents")).select("doc_id", F.col("pos").cast("long").alias("pos"), "block", F.md5("line").alias("line_md5"), "topic"),
)
