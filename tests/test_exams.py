"""Exam papers as text: golden rows for items, lines, blocks and whole papers."""

import pytest
from pyspark.sql import functions as F

from qbank.functions import items as I
from qbank.operators import exams

PAPERS = {
    "essay": ("简述什么是采样定理", [("essay", "简述什么是采样定理", "")]),
    "formula": ("求 $\\int_0^{1} x^2 \\, dx$ 的值", [("calc", "求 $\\int_0^{1} x^2 \\, dx$ 的值", "")]),
    "blank": ("求极限 lim_{x→0} = ____", [("blank", "求极限 lim_{x→0} = ____", "")]),
    "judge": ("判断下列说法是否正确：信号 f(t)=t 是能量信号", [("judge", "判断下列说法是否正确：信号 f(t)=t 是能量信号", "")]),
    "options": ("下列说法正确的是（ ）\nA. 甲\nB. 乙\nC. 丙\nD. 丁\n答案：A\n", [("single_choice", "下列说法正确的是（ ）", "A")]),
    "preamble": (
        "2024年秋季学期《电磁场》课程考试试卷（A卷）\n考试时间：120分钟 满分：100分\n注意事项：1．答案写在答题卡上；2．考试结束后试卷一并上交。\n一、单项选择题\n"
        "1．下列关于电磁波的说法正确的是（ ）\nA. 横波\nB. 纵波\nC. 标量波\nD. 机械波\n答案：A\n", [("single_choice", "下列关于电磁波的说法正确的是（ ）", "A")],
    ),
    "inline": (
        "1：题干一？答1：答案一\n问2：计算某个值。答2：① 1；② 2。\n二、分析作图题\n问1：画波形。答1：见附图。\n三、（10分）\n问：求系统函数。答：$H(z)=1$。\n后续答案行\n",
        [("blank", "题干一？", "答案一"), ("calc", "计算某个值。", "① 1；② 2。"), ("blank", "画波形。", "见附图。"), ("calc", "求系统函数。", "$H(z)=1$。\n后续答案行")],
    ),
    "section": ("二、填空题\n1．设函数 f(x)=x^2，则 f(0) 的值\n", [("blank", "设函数 f(x)=x^2，则 f(0) 的值", "")]),
    "key": ("1. 甲是（ ）\nA. 一 B. 二 C. 三\n2. 乙是（ ）\nA. 一 B. 二 C. 三\n\n答案：1.B 2.AC", [("single_choice", "甲是（ ）", "B"), ("single_choice", "乙是（ ）", "A")]),
    "key wins last": ("1. 甲是（ ）\nA. 一 B. 二\n1.A\n1.B", [("single_choice", "甲是（ ）", "B")]),
    "continued": ("1. 甲乙丙（ ）\n\nA. 一\n\nB. 二\n\n答案：A\n\n\n答案：B\n", [("single_choice", "甲乙丙（ ）", "A")]),
    "tags": ("【1-1】甲乙丙丁【1-2】戊己庚辛\n【答案】壬\n【解析】癸\n子", [("blank", "甲乙丙丁", ""), ("blank", "戊己庚辛", "壬")]),
    "marks": ("1. 【判断题】甲乙丙丁\n答案：错误的\n2、题干丙\n类型：多选题\nA 一\nB 二\n答案：b，a", [("judge", "甲乙丙丁", "错"), ("multiple_choice", "题干丙", "AB")]),
    "sub": ("（1）甲乙丙____\n（2）丁\n-----\n（2）戊己庚____", [("blank", "（1）甲乙丙____ （2）丁", ""), ("blank", "（2）戊己庚____", "")]),
    "nothing": ("\n \n第 1 页 / 共 2 页\n甲乙丙\n", []),
    "long digits": ("1" * 5000 + "x", []),
}


def test_papers(spark):
    names = list(PAPERS)
    df = spark.createDataFrame([(i, PAPERS[n][0], 0) for i, n in enumerate(names)] + [(99, None, 0)], "doc_id long, text string, line int")
    got = {}
    for r in exams.parse_exam(df).orderBy("doc_id", "pos").collect():
        got.setdefault(names[r["doc_id"]], []).append((r["qtype"], r["question"], r["answer"]))
    assert got == {n: want for n, (_, want) in PAPERS.items() if want}


def test_parts_of_papers(spark):
    df = spark.createDataFrame([(1, PAPERS["tags"][0]), (2, "知识点：采样定理\n【1-1】要保证无失真，频率应满足____。")], "doc_id long, text string")
    rows = exams.parse_exam(df).orderBy("doc_id", "pos").collect()
    assert [(r["topic"], r["explanation"], r["qnum"]) for r in rows] == [("", "", 1), ("", "癸\n子", 1), ("采样定理", "", 1)]
    assert exams.parse_exam(df.limit(0)).count() == 0


CASES = [
    (lambda: I.clean_answer(F.lit("1,2,3"), F.lit("multiple_choice")), "123"), (lambda: I.clean_answer(F.lit("A"), F.lit("judge")), "A"),
    (lambda: I.clean_answer(F.lit("√"), F.lit("judge")), "对"), (lambda: I.clean_answer(F.lit("（北京）"), F.lit("blank")), "北京"),
    (lambda: I.clean_answer(F.lit("(0,1]"), F.lit("blank")), "(0,1]"), (lambda: I.clean_answer(F.lit("（b）"), F.lit("single_choice")), "B"),
    (lambda: I.detect_qtype(F.lit("不定项选择题"), F.lit(0), F.lit(""), F.lit(None)), "multiple_choice"),
    (lambda: I.detect_qtype(F.lit(""), F.lit(0), F.lit("【多项选择题】下列哪些正确"), F.lit(None)), "multiple_choice"),
    (lambda: I.detect_qtype(F.lit(""), F.lit(0), F.lit("设 f(t)=t^2，画出波形"), F.lit(None)), "calc"),
    (lambda: I.detect_qtype(F.lit(""), F.lit(0), F.lit("请按要求完成填空"), F.lit(None)), "blank"),
    (lambda: I.detect_qtype(F.lit(""), F.lit(0), F.lit("比较零输入响应与零状态响应"), F.lit(None)), "essay"),
    (lambda: I.split_options(F.lit("A. 质量 B. 体积")), ["质量", "体积"]), (lambda: I.split_options(F.lit("见 A. 质量 B. 体积")), None),
    (lambda: I.is_answer_key(F.lit("3 5")), False), (lambda: I.is_answer_key(F.lit("答案：12.-1 13.18")), True), (lambda: I.is_answer_key(F.lit("1.A 2.B")), True),
    (lambda: I.item_number(F.lit("第 12 题 甲")), 12), (lambda: I.item_number(F.lit("【4-5】甲")), 4), (lambda: I.item_number(F.lit("甲 1.")), None),
    (lambda: I.needs_review(F.lit("电磁能流密度矢量 $s \\rh o$"), F.lit(""), F.lit(None), F.lit("")), True),
    (lambda: I.needs_review(F.lit("求 $\\sin x + \\cos x$ 的值"), F.lit(""), F.lit(None), F.lit("")), False),
    (lambda: I.needs_review(F.lit("已知 ( ) ω j F t f ↔ ，求频谱"), F.lit(""), F.lit(None), F.lit("")), True),
    (lambda: I.needs_review(F.lit("动摩擦因数为 、夹角为 ，重力加速度为 g"), F.lit(""), F.lit(None), F.lit("")), True),
    (lambda: I.has_blank_mark(F.lit("求 $x_i$ 的值")), False), (lambda: I.has_blank_mark(F.lit("是（ ）")), True),
]


def test_rules(spark):
    row = spark.range(1).select(*[make().alias(f"c{i}") for i, (make, _) in enumerate(CASES)]).first()
    assert list(row) == [want for _, want in CASES]


@pytest.mark.parametrize("line", ["1" * 15 + ".", "答案：" + "1 " * 30001 + "。", "1" * 100000 + "x", "1" * 100000 + "."])
def test_keys_are_found_in_bounded_time(spark, line):
    assert spark.range(1).select(I.is_answer_key(F.lit(line))).first()[0] is False
