"""Queries of the import: documents with pictures into the bank, with what they give by construction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qbank.functions import text as T
from qbank.operators import bank as B
from qbank.operators import imports as M
from qbank.plans import papers as P
from qbank.plans.fixtures import view, with_views
from qbank.plans.folds import fold_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str, query: Query) -> None:
    QUERIES[name], SQL[name] = query, with_views(f"SELECT * FROM ({sql})")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, "notes").withColumn("text", F.concat("text", F.lit("\n&nbsp;"))).unionByName(view(spark, sf_dir, "papers").withColumn("doc_id", F.col("doc_id") + 10**12))
    return docs.withColumns({"subject": F.when(F.col("doc_id") % 2 == 0, " 物理 "), "source_file": F.concat(F.lit("doc"), "doc_id", F.lit(".txt"))})


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.prepare(view(spark, sf_dir, "bank")).withColumns({"topic": F.lit(""), "explanation": F.lit("")})
    return rows.withColumns({"options": F.array().cast("array<string>"), "images": F.array().cast("array<string>")})


def _imported(spark: SparkSession, sf_dir: str) -> M.Imported:
    return M.import_documents(_bank(spark, sf_dir), _documents(spark, sf_dir), view(spark, sf_dir, "pictures"), view(spark, sf_dir, "known"))


_HASHED = r"md5(regexp_replace(concat({0}, options, answer), '[\s\\{{}}()【】\[\]（）.,，。、;；:：]+', '', 'g'))"
_KEY = _HASHED.format("question")
# The questions as the texts hold them; pictures by number, the rest in order; classes; equal stems; review; fingerprints.
_BOUND = f"""q0 AS (SELECT doc_id, nth AS pos, CASE WHEN reading = 'exam' THEN 1 END AS qnum, '' AS topic, qtype, question, '' AS options, answer, explanation, false AS damaged FROM ({P.notes_sql()})
 UNION ALL SELECT doc_id + 1000000000000, nth, qnum, topic, qtype, question, options, answer, explanation, pending_review FROM ({P.items_sql()})),
pl AS (SELECT doc_id, key, string_agg('【图:' || name || '】', ' ' ORDER BY place) AS anchors, count(*) AS k, min(place) AS first FROM pictures WHERE key IS NOT NULL GROUP BY 1, 2),
q1 AS (SELECT q0.*, CASE WHEN anchors IS NULL THEN question ELSE question || ' ' || anchors END AS q, coalesce(k, 0) AS k FROM q0 LEFT JOIN pl ON pl.doc_id = q0.doc_id AND pl.key = cast(qnum AS VARCHAR)),
rest AS (SELECT p.doc_id, p.name, row_number() OVER (PARTITION BY p.doc_id ORDER BY CASE WHEN p.key IS NULL THEN 0 ELSE 1 END, pl.first, place) AS nth FROM pictures p LEFT JOIN pl ON pl.doc_id = p.doc_id AND pl.key = p.key
 WHERE p.doc_id IN (SELECT doc_id FROM pl) AND (p.key IS NULL OR NOT EXISTS (SELECT 1 FROM q0 WHERE q0.doc_id = p.doc_id AND cast(q0.qnum AS VARCHAR) = p.key))),
free AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM q1 WHERE k = 0),
given AS (SELECT free.doc_id, pos, name, nth FROM free JOIN rest USING (doc_id, nth)),
bare AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS pos FROM pictures WHERE doc_id NOT IN (SELECT doc_id FROM pl)),
q2 AS (SELECT q1.*, q1.q || coalesce(' 【图:' || given.name || '】', '') AS stem, given.name IS NOT NULL AS bound, bare.name AS own FROM q1 LEFT JOIN given ON given.doc_id = q1.doc_id AND given.pos = q1.pos
 LEFT JOIN bare ON bare.doc_id = q1.doc_id AND bare.pos = q1.pos),
cl AS (SELECT q2.doc_id, q2.pos, list({{'old': '【图:' || name || '】', 'new': CASE WHEN kind = 'decorative' THEN '' ELSE '$' || trim(latex) || '$' END}}) AS swaps FROM (SELECT doc_id, pos, unnest(regexp_extract_all(stem, '【图:([^】]+)】', 1)) AS name FROM q2) q2
 JOIN known USING (name) WHERE kind = 'decorative' OR latex <> '{{' GROUP BY 1, 2),
q3 AS (SELECT q2.* EXCLUDE (question), coalesce(list_reduce(list_concat([stem], list_transform(swaps, lambda s: s.old || chr(1) || s.new)), lambda t, s: replace(t, split_part(s, chr(1), 1), split_part(s, chr(1), 2))), stem) AS question
 FROM q2 LEFT JOIN cl ON cl.doc_id = q2.doc_id AND cl.pos = q2.pos),
q4 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, question ORDER BY pos) AS same FROM q3),
found AS (SELECT doc_id, pos, doc_id::HUGEINT * 1000000000 + pos AS seq, CASE WHEN doc_id % 2 = 0 THEN '物理' ELSE '默认' END AS subject, '' AS course, topic, qtype, question, options, answer, explanation,
 array_to_string(list_sort(list_distinct(list_concat(CASE WHEN own IS NULL THEN [] ELSE [own] END, regexp_extract_all(question, '【图:([^】]+)】', 1)))), ',') AS images,
 concat('doc', doc_id, '.txt') AS source_file, bound OR (damaged AND length(question) < 15) AS pending_review,
 {_HASHED.format("regexp_replace(question, '【图:[^】]+】', '', 'g')").replace("options", "replace(options, '|', '')")} AS content_hash FROM q4 WHERE same = 1)"""
_OWN = rf"""(SELECT id, subject, course, '' AS topic, CASE lower(trim(qtype_raw)) WHEN 'single' THEN 'single_choice' WHEN 'multi' THEN 'multiple_choice' ELSE lower(trim(qtype_raw)) END AS qtype, question, '' AS options, answer,
 '' AS explanation, source_file, pending_review, md5(regexp_replace(concat(regexp_replace(question, '【图:[^】]+】', '', 'g'), coalesce(answer, '')), '[\s\\{{}}()【】\[\]（）.,，。、;；:：]+', '', 'g')) AS content_hash FROM bank)""".replace("\\\\", "\\")
# Of equal stems in a document the first counts; of each fingerprint that the bank lacks, the first in the order of documents.
_add(
    "I11_import",
    f"""WITH q0 AS (SELECT doc_id, nth AS pos, qtype, question, '' AS options, answer, false AS pending_review FROM ({P.notes_sql()})
 UNION ALL SELECT doc_id + 1000000000000, nth, qtype, question, replace(options, '|', ''), answer, pending_review FROM ({P.items_sql()})),
q AS (SELECT *, {_KEY} AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, question ORDER BY pos) AS same FROM q0) WHERE same = 1),
u AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id, pos) = 1 AND content_hash NOT IN (SELECT content_hash FROM {_OWN}) AS new FROM q)
SELECT qtype, count(*) FILTER (new) AS inserted, count(*) FILTER (NOT new) AS merged, count(*) FILTER (pending_review) AS pending, count(*) AS total FROM u GROUP BY qtype""",
    lambda s, d: M.summary(B.prepare(view(s, d, "bank")), _documents(s, d).drop("subject", "source_file")),
)
_LISTED = {"options": "|", "images": ",", "files": ","}


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.array_join(c, sep) for c, sep in _LISTED.items() if c in df.columns})


_add(
    "I11_import_questions",
    f"""WITH {_BOUND}, {fold_sql(_OWN, 'found')} SELECT x.doc_id, x.pos, x.subject, x.topic, x.qtype, x.question, x.options, x.answer, x.explanation, x.images, x.source_file, x.pending_review, x.content_hash,
 m.id, CASE WHEN new AND x.seq = m.first THEN 'inserted' ELSE 'merged' END AS outcome FROM found x JOIN m USING (content_hash)""",
    lambda s, d: (lambda out: _flat(out.questions.join(out.outcomes, "seq").select(
        "doc_id", "pos", "subject", "topic", "qtype", "question", "options", "answer", "explanation", "images", "source_file", "pending_review", "content_hash", "id", "outcome")))(_imported(s, d)),
)
_add(
    "I11_import_bank",
    f"WITH {_BOUND}, {fold_sql(_OWN, 'found')} SELECT id, content_hash, b.s AS subject, b.t AS topic, b.k AS qtype, s.q AS question, s.o AS options, s.a AS answer, s.x AS explanation, s.p AS pending_review, files FROM m",
    lambda s, d: _flat(_imported(s, d).bank.select("id", "content_hash", "subject", "topic", "qtype", "question", "options", "answer", "explanation", "pending_review", "files")),
)
_add(
    "I11_import_images",
    f"""WITH {_BOUND}, d AS (SELECT doc_id FROM q0 UNION SELECT doc_id FROM rest) SELECT doc_id, (SELECT coalesce(sum(k), 0) FROM q1 WHERE q1.doc_id = d.doc_id)::BIGINT AS certain,
 (SELECT count(*) FROM given WHERE given.doc_id = d.doc_id) AS uncertain, (SELECT count(*) FROM rest WHERE rest.doc_id = d.doc_id AND NOT EXISTS (SELECT 1 FROM given g WHERE g.doc_id = rest.doc_id AND g.nth = rest.nth)) AS leftover FROM d""",
    lambda s, d: M.import_questions(_documents(s, d), view(s, d, "pictures"), view(s, d, "known"))[1],
)
