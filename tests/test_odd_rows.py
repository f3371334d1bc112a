"""Queries against DuckDB on rows that the supplied small tables do not hold."""

import hashlib
import itertools
import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from qbank.plans.fixtures import TABLES
from qbank.queries import oracle_sql, queries
from tests.test_queries import SF, rows


@pytest.fixture
def compared(spark, tmp_path):
    """Compares a query with its SQL on the smallest tables, some of them replaced by others."""

    def compare(name, **changed):
        con = duckdb.connect()
        for t in TABLES:
            own = changed.get(t, spark.read.parquet(f"{SF}/{t}.parquet"))
            own.write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        got = queries()[name](spark, str(tmp_path)).toPandas()
        assert rows(got) == rows(con.execute(oracle_sql()[name]).df())
        return got

    return compare


def test_entities_without_a_semicolon(spark, compared):
    htmls = ["<title>and&amp</title>", "&ampamp;lt; &amp;amp;lt;", "&notit; &notin; &Aacute", "&#38;#38;#38; &#x26 &#128;&#xD800;&#1;", None]
    compared("H2_html_unescape", pages=spark.createDataFrame([(i, "u", h) for i, h in enumerate(htmls)], "page_id long, url string, html string"))


def test_import_of_equal_stems_in_a_document(spark, compared):
    # The second document's notes ask for the same word twice, with two answers; the bank holds what the seventh's notes ask.
    digest = lambda i: hashlib.md5(f"t{i}".encode()).hexdigest()
    twice = next(f"t{i}" for i in itertools.count() if digest(i)[:4] == digest(i)[8:12])
    word = lambda k: "w" + digest(1)[k - 1:k + 3]
    docs = [(2, twice), (7, "t1"), (12, f"简述{word(21)}。")]
    got = compared("I11_import", documents=spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long"))
    essays = got[got["qtype"] == "essay"].iloc[0]
    assert (essays["inserted"], essays["merged"]) == (7, 1)


def documents(spark, texts):
    """Each text under every kind of noise, by doc_id % 5."""
    docs = [(5 * i + k, t, "en", "s", len(t or "")) for i, t in enumerate(texts) for k in range(5)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")


NOTHING = [None, "", " ", "\n \n", "\t", "\r\n", "\xa0", "\u3000"]


def test_lines_of_odd_texts(spark, compared):
    ends = [f"一二三四{e}x{e}{e} {e}一二三四 y" for e in ("\r", "\r\n", "\n", "\x0b", "\x0c", "\x1c", "\x1e", "\x1f", "\x85", "\u2028", "\u2029", "\t", "\u3000")]
    half = "\n".join(["一二三四"] * 41 + ["x"] * 5079)  # 0.0080078125
    got = compared("H11_cjk_line_ratio", documents=documents(spark, [*NOTHING, *ends, half])).set_index("doc_id")["ratio"]
    assert (got[4], got[9], got[5 * len(NOTHING) + 4], got[got.index.max()]) == (0, 0, 0.666666667, 0.008007813)


def test_tokens_of_odd_texts(spark, compared):
    spaces = [f"a{e}bc{e}{e}d 一{e}$" for e in ("\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u200b", "\u2028", "\u202f", "\u205f", "\u3000")]
    half = " ".join(["x"] * 41 + ["yy"] * 5079)  # 0.0080078125
    got = compared("H8_single_char_ratio", documents=documents(spark, [*NOTHING, *spaces, "\U00020000 a\U00020000", half])).set_index("doc_id")["ratio"]
    assert (got[4], got[9], got[5 * len(NOTHING) + 4], got[got.index.max()]) == (0, 0, 0.4, 0.008007813)


@pytest.mark.parametrize("name", ["D11_quality_profile", "H12_quality_score", "H12_quality_commands", "I12_ocr_choice"])
def test_quality_of_odd_texts(spark, compared, name):
    nothing = NOTHING[1:] if name == "D11_quality_profile" else NOTHING  # pandas makes doubles of counts among nulls
    compared(name, documents=documents(spark, [*nothing, "a\xa0b", "a\x0bb", "a\rb", "x\u2028一二三四", "a\rb\rc\rd\re\rf\rlong line"]))
