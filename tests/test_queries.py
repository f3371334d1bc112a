"""Every query of the inventory against DuckDB on the smallest tables, and golden rows for rules that these cannot trigger."""

import html
import os
from html.entities import html5

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from qbank.functions import answers, latex, text
from qbank.operators import layout, upsert
from qbank.plans.fixtures import TABLES
from qbank.queries import oracle_sql, queries
from qbank.sources import tables

SF = "/root/testdata/sf0.001"


def rows(df):
    clean = lambda v: None if v is None or v is pd.NA or v is pd.NaT or v != v else round(v, 9) if isinstance(v, float) else v
    return sorted(repr(tuple(clean(v) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(queries()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(oracle_sql()[name]).df()
    got = queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def values(spark, cases, make):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], ["i", *[f"c{j}" for j in range(len(cases[0]))]])
    return [r["x"] for r in df.withColumn("x", make(*[F.col(f"c{j}") for j in range(len(cases[0]))])).orderBy("i").collect()]


def test_unescape(spark):
    got = values(spark, [("|z|&gt;3 &lt; x",), ("&amp;lt;",), ("&#x5728; &#50;",), ("a & b &unknown; &#0; &",)], text.html_unescape)
    assert got == ["|z|>3 < x", "<", "在 2", "a & b &unknown; \ufffd &"]


def test_unescape_as_the_standard_library(spark):
    cases = [f"a&{n}b" for n in html5] + [f"&{n.rstrip(';')}z; &{n.rstrip(';')} q" for n in html5]
    cases += [f"&#{i};&#x{i:x}" for i in [*range(400), 0xD7FF, 0xD800, 0xE000, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000, 10**30]]
    cases += ["&#00065 ", "&;", "&#;", "&#x;", "&#a", "&notit;", "&ampamp;", "&copy 2020", "&lt<", "&é;", "a&\nb", "&" + "a" * 50 + ";", ""]
    assert values(spark, [(c,) for c in cases], text.unescape_once) == list(map(html.unescape, cases))


def test_cleaning_with_formulas(spark):
    got = values(spark, [("第 1 页 / 共 2 页\r\n x &le; 1/2 \n-----\n\n½",)], lambda c: text.rule_clean(c, latex.unicode_to_latex))
    assert got == ["x \\leq \\frac{1}{2}\n\\frac{1}{2}"]


def test_fingerprint(spark):
    a, b, c = values(spark, [("题干一；", "1"), ("题干一", "1"), ("【图:a.png】题 干一\\", "1")], text.content_hash)
    assert a == b == c


def test_quality_of_blank_text(spark):
    got = values(spark, [("  \n",), ("\\rh o \\Delt a",)], text.quality_score)
    assert (got[0]["score"], got[0]["fragmented"], got[1]["score"], got[1]["fragmented"]) == (1.0, True, 0.8, True)


def test_latex_ok(spark):
    assert values(spark, [("\\frac{1}{2}",), ("{",), ("a$",), ("\\begin{x}",), ("\\rhoé",), (" ",)], text.latex_ok) == [True, False, False, False, True, False]


def test_verdicts(spark):
    assert values(spark, [("不正确",), ("正确",), ("不完全对",), ("\n回答错误",), ("对，但…",), ("?",)], answers.verdict) == [False, True, False, False, True, None]


def test_checked_answers(spark):
    cases = [
        ("calc", "0.5", "1/2", None, True), ("calc", "1.414", "√2", None, True), ("calc", "1.5708", "π/2", None, True), ("calc", "1001", "1000", None, False),
        ("calc", "2", "1/2", None, False), ("calc", "5", "1/0", None, False), ("blank", "北京、上海", "上海，北京", None, True), ("judge", "错", "A", ["A. 错", "B. 对"], True),
        ("multiple_choice", "c, a", "A,C", None, True), ("single_choice", "b", "B", None, True), ("essay", "x", "x", None, False), ("blank", "", "x", None, False), ("blank", None, None, None, False),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, qtype string, u string, r string, o array<string>, want boolean")
    got = answers.check_answers(df, "u", "r", options="o").orderBy("i").collect()
    assert [(r["u"], bool(r["ok"])) for r in got] == [(r["u"], r["want"]) for r in got]


def test_attribution(spark):
    marks = spark.createDataFrame(
        [("d", 1, 5.0, 1, None, "a", 0), ("d", 1, 30.0, 1, None, "b", 1), ("d", 1, 70.0, 1, None, "c", 2), ("d", 1, 10.0, 0, "1", None, 3), ("d", 1, 40.0, 0, "2", None, 4)],
        "doc string, page int, y double, kind int, key string, fname string, event_id int",
    )
    assert {r["fname"]: r["question"] for r in layout.attribute(marks).collect()} == {"a": None, "b": "1", "c": "2"}


def test_upsert_keeps_anchors_and_collects_files(spark):
    cols = "content_hash string, {} long, question string, answer string, source_file string, pending_review boolean"
    own = spark.createDataFrame([("h", 1, "q 【图:a】", "1", "a.pdf", False)], cols.format("id"))
    batch = spark.createDataFrame([("h", 1, "q.", "1", "b.pdf", True), ("h", 2, "q.", "1", "a.pdf", False), ("n", 3, "z", "", "c.pdf", False)], cols.format("seq"))
    got = {r["content_hash"]: r for r in upsert.upsert(own, batch).collect()}
    assert (got["h"]["question"], got["h"]["files"], got["h"]["pending_review"]) == ("q 【图:a】", ["a.pdf", "b.pdf"], True)
    assert got["n"]["files"] == ["c.pdf"]


def test_upsert_unites_images_as_file_names(spark):
    columns = "content_hash string, question string, answer string, source_file string, pending_review boolean, images array<string>"
    own = spark.createDataFrame([(7, "h", "q", "A", "one", False, ["b.png", "a.png"]), (8, "k", "p", "B", "one", False, None)], f"id long, {columns}")
    batch = spark.createDataFrame(
        [(1, "h", "q", "A", "two", False, ["x/a.png", "y\\c.png"]), (2, "k", "p", "B", "two", True, None), (3, "n", "r", "C", "two", False, ["z/d.png", "d.png", None])], f"seq long, {columns}"
    )
    got = {r["content_hash"]: (r["id"], r["images"], r["files"]) for r in upsert.upsert(own, batch).collect()}
    assert got == {"h": (7, ["b.png", "a.png", "c.png"], ["one", "two"]), "k": (8, [], ["one", "two"]), "n": (None, ["d.png"], ["two"])}
    assert upsert.upsert(own.limit(0), batch.limit(0)).count() == 0


def test_texts_and_images_as_files(spark, tmp_path):
    texts = {"a.txt": "\ufeff题".encode(), "b.md": "题目é".encode("gb18030"), "c.text": b"ok \xff\xfe", "d.txt": b"", "e.pdf": b"no"}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "deep").mkdir()
    for name in ("b.PNG", "deep/c.jPeg", "png", "d.png.txt"):
        (tmp_path / name).write_bytes(b"\x89")
    got = {r["path"].rpartition("/")[2]: (r["text"], r["encoding"]) for r in tables.read_texts(spark, str(tmp_path)).where("path NOT LIKE '%png.txt'").collect()}
    assert got == {"a.txt": ("题", "utf-8"), "b.md": ("题目é", "gb18030"), "c.text": ("ok \ufffd\ufffd", "replaced")}  # no row of an empty file
    assert {r["path"].rpartition("/")[2] for r in tables.list_images(spark, str(tmp_path)).collect()} == {"b.PNG", "c.jPeg"}
    nothing = spark.createDataFrame([("x", None)], "path string, content binary")
    assert [tuple(r) for r in tables.decode_text(nothing).collect()] == [("x", None, None)]


def test_papers_and_records(spark, tmp_path):
    paper = spark.createDataFrame([("P2", 1, None), ("P1", 2, "x")], "id string, n int, title string")
    for _ in range(2):
        tables.write_papers(paper, str(tmp_path / "papers"))
    tables.write_papers(paper.where("id = 'P1'").withColumn("n", F.lit(3)), str(tmp_path / "papers"))
    (tmp_path / "papers" / "id=P3").mkdir()
    (tmp_path / "papers" / "id=P3" / "p.json").write_text("{no json\n")
    found = tables.read_papers(spark, str(tmp_path / "papers"), "n int, title string")
    assert [(r["id"], r["n"]) for r in tables.list_papers(found).collect()] == [("P2", 1), ("P1", 3)]
    assert [(r["id"], r["damaged"].strip()) for r in found.where("damaged IS NOT NULL").collect()] == [("P3", "{no json")]
    for batch in ("one", "two", "one"):
        tables.append(paper, str(tmp_path / "records"), batch)
    assert tables.read_appended(spark, str(tmp_path / "records")).count() == 4
    items = spark.createDataFrame([("r/1", 2, 'a "b", c', "", " x", "wrong", 0.5, "说"), ("r/1", 1, "q\nq", "A", "B", "correct", 1.0, "")], "paper_id string, n int, question string, correct_answer string, user_answer string, status string, score double, comment string")
    tables.export_csv(items, str(tmp_path / "csv"))
    (file,) = (tmp_path / "csv").glob("*/*.csv")
    assert file.read_text(encoding="utf-8-sig").splitlines()[0] == "题号,题目,标准答案,作答,状态,得分,点评" and file.read_bytes().startswith(b"\xef\xbb\xbf")
    assert [tuple(r) for r in tables.read_exported(spark, str(tmp_path / "csv")).select(items.columns).orderBy("n").collect()] == [tuple(r) for r in items.orderBy("n").collect()]
    tables.export_json(items.limit(1).select("paper_id", F.lit(None).cast("string").alias("title")), str(tmp_path / "json"))
    (file,) = (tmp_path / "json").glob("*/*.json")
    assert file.read_text().strip() == '{"title":null}'
