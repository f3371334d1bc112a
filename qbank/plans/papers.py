"""Exam papers made of words that depend on each document's whole text, and what they hold by construction, in portable SQL."""

from __future__ import annotations

import re


def text_sql(template: str) -> str:
    """An SQL string with {k} for a word taken from the digest of the document's text; line ends and backslashes by code.

    A number that shall stay in braces has them doubled.
    """
    parts = []
    for piece in re.split(r"(\{\{\d+\}\}|\{\d+\}|\n|\\)", template):
        if piece in ("\n", "\\"):
            parts.append(f"chr({ord(piece)})")
        elif piece.startswith("{{"):
            parts.append(f"'{piece[1:-1]}'")
        elif re.fullmatch(r"\{\d+\}", piece):
            parts.append(f"concat('w', substr(md5(coalesce(text, '')), {piece[1:-1]}, 4))")
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return f"concat({', '.join(parts)})" if parts else "''"


#: One layout for each remainder of doc_id by their number, and its questions: block, number, topic, type, stem, options (joined
#: by |), answer in the block, explanation, answer after the key, review.
LAYOUTS = (
    (
        "一、单选题\n1. {1} {5} 正确的是（ ）\nA. {9}\nB. {13}\n答案：B\n二、填空题\n2. {17} = ____\n答案：{21}\n三、判断题\n3. {2} {6}\n答案：正确",
        (
            (1, 1, "", "single_choice", "{1} {5} 正确的是（ ）", "{9}|{13}", "B", "", "B", False), (2, 2, "", "blank", "{17} = ____", "", "{21}", "", "{21}", False),
            (3, 3, "", "judge", "{2} {6}", "", "对", "", "对", False),
        ),
    ),
    (
        "{1}期末考试试卷 满分100分\n姓名：____\n\n1、{5}是（ ）\nA. {9} B. {13} C. {17}\n2、{21}是（ ）\n\nA. {25} B. {28}\n\n答案：1.C 2.A",
        (
            (2, 1, "", "single_choice", "{5}是（ ）", "{9}|{13}|{17}", "", "", "C", True),
            (3, 2, "", "single_choice", "{21}是（ ）", "{25}|{28}", "", "", "A", True),
        ),
    ),
    (
        "知识点：{1}\n【1-1】{5} 的值为____。【1-2】{9} 简述\n【答案】{13}\n【解析】{17}\n{21}",
        (
            (1, 1, "{1}", "blank", "{5} 的值为____。", "", "", "", "", False),
            (2, 1, "{1}", "blank", "{9} 简述", "", "{13}", "{17}\n{21}", "{13}", False),
        ),
    ),
    (
        "问1：{1} 怎样？答1：{5}\n{9} 续\n-----\n（2）计算 {13} 的值\n解析：{17}",
        (
            (1, 1, "", "blank", "{1} 怎样？", "", "{5}\n{9} 续", "", "{5}\n{9} 续", False),
            (2, None, "", "calc", "（2）计算 {13} 的值", "", "", "{17}", "", False),
        ),
    ),
    (
        "二、多选题\n1. {1} 属于\nA、{5}\nB、{9}\nC、{13}\n答案：CA\n解析：{17}\n\n2. {21} 属于\n题型：多选题\nA、{5}\nB、{9}\n\n{25}",
        (
            (1, 1, "", "multiple_choice", "{1} 属于", "{5}|{9}|{13}", "AC", "{17}", "AC", False),
            (2, 2, "", "multiple_choice", "{21} 属于", "{5}|{9}", "", "", "", False),
            (3, None, "", "multiple_choice", "{25}", "", "", "", "", False),
        ),
    ),
)

#: The blocks of each layout: block, lines, first line, section, topic.
BLOCKS = (
    ((1, 4, "1. {1} {5} 正确的是（ ）", "single_choice", ""), (2, 2, "2. {17} = ____", "blank", ""), (3, 2, "3. {2} {6}", "judge", "")),
    ((2, 2, "1、{5}是（ ）", None, ""), (3, 3, "2、{21}是（ ）", None, "")),
    ((1, 1, "【1-1】{5} 的值为____。", None, "{1}"), (2, 4, "【1-2】{9} 简述", None, "{1}")),
    ((1, 2, "问1：{1} 怎样？答1：{5}", None, ""), (2, 2, "（2）计算 {13} 的值", None, "")),
    ((1, 6, "1. {1} 属于", "multiple_choice", ""), (2, 4, "2. {21} 属于", "multiple_choice", ""), (3, 1, "{25}", "multiple_choice", "")),
)


def by_layout(exprs: list[str], key: str = "doc_id") -> str:
    """One SQL expression for each layout."""
    return f"CASE {key} % {len(exprs)} " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(exprs)) + " END"


#: Notes and other texts, one for each remainder of doc_id by their number: text, readings (exam, points, sections), and the questions
#: of its reading: reading, place, type, stem, answer, explanation.
NOTES = (
    (
        "1、{1}【名词解释】\n{5}\n{9}\n2、{13}\n{17}\n单选题：\n{21} {25}\n3、{2}（单选）\n{6}", (False, True, False),
        (
            ("points", 1, "thinking", "名词解释：{1}", "{5}\n{9}", ""), ("points", 2, "essay", "简述{13}。", "{17}", ""), ("points", 3, "judge", "{2}", "对", "{6}"),
            ("points", 4, "judge", "{21} {25}", "对", ""),
        ),
    ),
    (
        "第一章 {1}\n第一节、{5}\n{9}\n{13}\n第二节 {17}\n第二章 {21}\n{25}\n导论 如何{2}\n{6}", (False, False, True),
        (("sections", 1, "essay", "简述{5}。", "{9}\n{13}", ""), ("sections", 2, "essay", "如何{2}", "{6}", "")),
    ),
    (
        "第一节 {1}\n{5}\n1、{9}\n{13}\n第二节\n{17}\n2、{21}", (False, True, True),
        (
            ("sections", 1, "essay", "简述{1}。", "{5}\n1、{9}\n{13}", ""), ("points", 1, "essay", "简述{9}。", "{13}\n第二节\n{17}", ""),
            ("points", 2, "essay", "简述{21}。", "", ""),
        ),
    ),
    ("一、判断题\n1. {1} 与 {5}\n答案：错\n第一节 {9}", (True, False, False), (("exam", 1, "judge", "{1} 与 {5} 第一节 {9}", "错", ""),)),
    ("1、{1} 与 {5} 相同____\n答案：{9}", (True, False, False), (("exam", 1, "blank", "{1} 与 {5} 相同____", "{9}", ""),)),
)

#: Pictures of the documents above (those of papers under doc_id + 10**12): without a number, with one of an item or with one that no
#: item has; every sixth document's have none. And what is known of some of them.
_SHOWN = """select event_id as place, concat('pic', cast(event_id as string), '.png') as name,
 case when doc % 6 = 0 then null else case floor(event_id / 2) % 4 when 1 then '1' when 2 then '2' when 3 then '9' end end as key,
 case when event_id % 2 = 0 then doc else doc + 1000000000000 end as doc_id from (select event_id, cast(floor(event_id / 3) as bigint) % (select count(*) from documents) as doc from events) as e"""
_KNOWN = """select name, kind, latex from (select name, case place % 5 when 0 then 'formula' when 1 then 'decorative' when 2 then 'formula' end as kind,
 case place % 5 when 0 then concat(' x_{', cast(place as string), '} ') when 2 then '{' end as latex from pictures) as p where kind is not null"""

VIEWS = {"pictures": _SHOWN, "known": _KNOWN, "notes": f"select doc_id, {by_layout([text_sql(n[0]) for n in NOTES])} as text from documents", "papers": f"select doc_id, {by_layout([text_sql(t) for t, _ in LAYOUTS])} as text from documents"}


def _value(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else text_sql(x)


def _rows(tables: tuple, columns: tuple[str, ...]) -> str:
    """The rows of all documents; nth is a row's place among those of its document, as they are listed."""
    found = []
    for i, rows in enumerate(tables):
        for nth, row in enumerate(rows):
            found.append(f"SELECT doc_id, {nth + 1} AS nth, " + ", ".join(f"{_value(v)} AS {c}" for v, c in zip(row, columns, strict=True)) + f" FROM documents WHERE doc_id % {len(tables)} = {i}")
    return "\nUNION ALL ".join(found)


ITEM_COLUMNS = ("block", "qnum", "topic", "qtype", "question", "options", "given", "explanation", "answer", "pending_review")


def items_sql() -> str:
    """The questions of all papers."""
    return _rows(tuple(items for _, items in LAYOUTS), ITEM_COLUMNS)


def blocks_sql() -> str:
    return _rows(BLOCKS, ("block", "n_lines", "first_line", "section", "topic"))


def notes_sql() -> str:
    """The questions of all notes."""
    return _rows(tuple(n[2] for n in NOTES), ("reading", "pos", "qtype", "question", "answer", "explanation"))


def readings_sql() -> str:
    return _rows(tuple((n[1],) for n in NOTES), ("as_exam", "as_points", "as_sections"))
