"""One query for each operator of the inventory, over whole tables, and SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from qbank import exam_queries, import_queries
from qbank.functions import answers as A
from qbank.functions import text as X
from qbank.operators import bank as B
from qbank.operators import binding as K
from qbank.operators import layout as L
from qbank.operators import lines as N
from qbank.operators import papers as P
from qbank.operators import search as S
from qbank.operators import upsert as U
from qbank.plans.fixtures import view, with_views
from qbank.plans.folds import fold_sql
from qbank.schemas import LEGACY_QTYPES, QTYPE_LABELS, QTYPES
from qbank.sources import tables as T
from qbank.sources.stage import folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = with_views(f"SELECT * FROM ({sql})")
        return f

    return keep


_NORMAL = "CASE lower(trim({0})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ({q: q for q in QTYPES} | LEGACY_QTYPES).items()) + " ELSE 'blank' END"
_LABEL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in QTYPE_LABELS.items()) + " ELSE {0} END"
_HASH = r"md5(regexp_replace(concat(regexp_replace({0}, '【图:[^】]+】', '', 'g'), coalesce({1}, '')), '[\s\\{{}}()【】\[\]（）.,，。、;；:：]+', '', 'g'))"
_OWN = f"(SELECT *, {_NORMAL.format('qtype_raw')} AS qtype, {_HASH.format('question', 'answer')} AS content_hash FROM bank)"
_BATCH = f"(SELECT *, {_NORMAL.format('qtype_raw')} AS qtype, {_HASH.format('question', 'answer')} AS content_hash FROM incoming)"


def _defaults() -> dict:
    return {"answer": F.lit(""), "formula": F.lit(""), "reviewed": F.lit(False)}


def _bank(spark, sf) -> DataFrame:
    return B.prepare(view(spark, sf, "bank"))


def _batch(spark, sf) -> DataFrame:
    return B.prepare(view(spark, sf, "incoming"))


_COLUMNS = ("id", "subject", "qtype", "question", "answer", "pending_review")
_LIST = ", ".join(_COLUMNS)

_add("A1_scan_bank", f"SELECT {_LIST}, CASE id % 4 WHEN 0 THEN subject || '|' || course ELSE '' END AS options FROM {_OWN}")(
    lambda s, d: T.decode_lists(
        _bank(s, d).withColumn("options", F.expr("CASE id % 4 WHEN 0 THEN to_json(array(subject, course)) WHEN 1 THEN '' WHEN 2 THEN 'no list' END")), ["options"]
    ).select(*_COLUMNS, F.array_join("options", "|").alias("options"))
)
_add("A3_cells_to_line", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' | ') AS line FROM documents")(
    lambda s, d: view(s, d, "documents").select("doc_id", T.cells_to_line(F.split("text", "\n")).alias("line"))
)
_add("A4_export_record", "SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY event_id) AS n, question_id, user_answer FROM submissions")(
    lambda s, d: T.export_items(view(s, d, "submissions").groupBy("paper_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("event_id", "question_id", "user_answer"))), lambda x: F.struct(x.question_id.alias("question_id"), x.user_answer.alias("user_answer"))).alias("answers")
    ))
)
_add("A7_schema_backfill", "SELECT id, coalesce(nullif(answer, ''), '') AS answer, '' AS formula, false AS reviewed FROM bank")(
    lambda s, d: T.backfill(T.backfill(view(s, d, "bank").select("id", "answer"), _defaults()), _defaults())
)
_add("A8_index_snapshot", f"SELECT id, substring(question, 1, 200) AS head, subject, qtype FROM {_OWN}")(lambda s, d: T.index_snapshot(_bank(s, d)))

_add("B1_get_by_id", f"SELECT {_LIST} FROM {_OWN} WHERE id IN (SELECT question_id FROM submissions)")(
    lambda s, d: B.by_ids(_bank(s, d), view(s, d, "submissions").select(F.col("question_id").alias("id"))).select(*_COLUMNS)
)
_add("B2_find_by_text", "SELECT question, min(id) AS id FROM bank WHERE question IN (SELECT question FROM incoming) GROUP BY question")(
    lambda s, d: B.first_by_text(_bank(s, d), _batch(s, d))
)
_add("B3_find_by_hash", f"SELECT content_hash, min(id) AS id FROM {_OWN} WHERE content_hash IN (SELECT content_hash FROM {_BATCH}) GROUP BY content_hash")(
    lambda s, d: B.first_by_hash(_bank(s, d), _batch(s, d))
)
_add("B4_list_questions", f"SELECT {_LIST} FROM {_OWN} WHERE subject LIKE 'src%' AND qtype = 'multiple_choice' AND (question ILIKE '%IN%' OR course ILIKE '%IN%' OR subject ILIKE '%IN%')")(
    lambda s, d: B.matching(_bank(s, d).withColumn("topic", F.col("course")), "", "multi", "IN").select(*_COLUMNS)
)
_add("B6_list_pending", f"SELECT {_LIST} FROM {_OWN} WHERE pending_review ORDER BY id DESC LIMIT 50")(lambda s, d: B.page(B.pending(_bank(s, d)), 1, 50).select(*_COLUMNS))
_add("B7_qtype_label", f"SELECT id, {_LABEL.format('qtype_raw')} AS raw_label, {_LABEL.format('qtype')} AS label FROM {_OWN}")(
    lambda s, d: _bank(s, d).select("id", X.qtype_label(F.col("qtype_raw")).alias("raw_label"), X.qtype_label(F.col("qtype")).alias("label"))
)
_add("B8_normalize_qtype", f"SELECT id, {_NORMAL.format('qtype_raw')} AS qtype FROM bank")(lambda s, d: _bank(s, d).select("id", "qtype"))
_add("B9_has_answer", "SELECT id, trim(answer) <> '' AND answer NOT LIKE '%（待补充答案）%' AS has_answer FROM bank")(lambda s, d: B.answered(_bank(s, d)).select("id", "has_answer"))
_add("B10_delete_by_ids", f"SELECT {_LIST} FROM {_OWN} WHERE id NOT IN (SELECT doc_id + 1 FROM labels WHERE quality = 0)")(
    lambda s, d: B.without_ids(_bank(s, d), view(s, d, "labels").where("quality = 0").selectExpr("explode(array(doc_id + 1, -doc_id)) AS id")).select(*_COLUMNS)
)
_add("B11_basename", "SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE source_file END AS name FROM bank")(
    lambda s, d: view(s, d, "bank").select("id", X.basename(F.concat(F.when(F.col("id") % 3 == 0, F.lit("a/..")).when(F.col("id") % 3 == 1, F.lit("a\\b/")).otherwise(F.lit("")), "source_file")).alias("name"))
)
_add("B12_clear_pending", "SELECT id, pending_review AND id % 2 = 1 AS pending_review FROM bank")(
    lambda s, d: B.clear_pending(_bank(s, d), _batch(s, d).select(F.col("seq").alias("id"))).select("id", "pending_review")
)
_PATCHED = """SELECT b.id, coalesce(i.question, b.question) AS question, {0} AS answer, CASE WHEN i.seq IS NULL THEN b.pending_review ELSE false END AS pending_review
 FROM bank b LEFT JOIN incoming i ON i.seq = b.id"""
_add("B13_resolve_pending", f"SELECT *, {_HASH.format('question', 'answer')} AS content_hash FROM ({_PATCHED.format('b.answer')})")(
    lambda s, d: B.patch(_bank(s, d), _batch(s, d).select(F.col("seq").alias("id"), "question", F.lit(None).cast("string").alias("answer")), ("question", "answer"), resolve=True).select(
        "id", "question", "answer", "pending_review", "content_hash"
    )
)
_add("B14_fill_answer", f"SELECT id, answer, {_HASH.format('question', 'answer')} AS content_hash FROM (SELECT b.id, b.question, CASE WHEN i.seq IS NULL THEN b.answer ELSE i.source_file END AS answer FROM bank b LEFT JOIN incoming i ON i.seq = b.id)")(
    lambda s, d: B.patch(_bank(s, d), _batch(s, d).select(F.col("seq").alias("id"), F.concat(F.lit("  "), "source_file", F.lit(" \t")).alias("answer")), ("answer",), trim=True).select("id", "answer", "content_hash")
)
_add("B16_insert_question", f"SELECT id, qtype, question FROM {_OWN} UNION ALL SELECT (SELECT max(id) FROM bank) + row_number() OVER (ORDER BY seq), qtype, question FROM {_BATCH}")(
    lambda s, d: B.insert(_bank(s, d).select("id", "qtype", "question"), _batch(s, d).select("seq", "qtype", "question"))
)

_add("C1_answers_to_paper", "SELECT paper_id, question_id, arg_max(user_answer, event_id) AS user_answer FROM submissions GROUP BY 1, 2")(lambda s, d: P.last_answers(view(s, d, "submissions")))
_add("C6_image_asof", "SELECT doc, event_id, fname, question FROM (SELECT *, last_value(key IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, y, kind, event_id ROWS UNBOUNDED PRECEDING) AS question FROM marks) WHERE kind = 1")(
    lambda s, d: L.attribute(view(s, d, "marks"))
)
_REFS = "(SELECT unnest(regexp_extract_all(question, '【图:([^】]+)】', 1)) AS name FROM anchored UNION SELECT image FROM anchored WHERE image IS NOT NULL)"
_add("C8_missing_files", f"SELECT name FROM {_REFS} WHERE name NOT IN (SELECT name FROM files)")(lambda s, d: L.missing_files(view(s, d, "anchored"), view(s, d, "files")))
_add("C9_orphan_files", f"SELECT name FROM files WHERE name NOT IN (SELECT name FROM {_REFS})")(lambda s, d: L.orphan_files(view(s, d, "anchored"), view(s, d, "files")))
_add("C10_similar_topk", """WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM u),
 p AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e) / (q.n * x.n) AS score FROM n q JOIN n x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0)
 SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5 AND score >= 0.3""")(
    lambda s, d: (lambda ix: S.similar(ix, ix.where("vec_id % 50 = 0"), threshold=0.3).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score")))(S.index(view(s, d, "embeddings")))
)
_add("C11_match_existing", f"SELECT seq, CASE WHEN content_hash IN (SELECT content_hash FROM {_OWN}) OR row_number() OVER (PARTITION BY content_hash ORDER BY seq) > 1 THEN 'merged' ELSE 'inserted' END AS outcome FROM {_BATCH}")(
    lambda s, d: B.outcomes(_bank(s, d), _batch(s, d)).select("seq", "outcome")
)
_add("C12_cache_hit_miss", "SELECT DISTINCT image AS name FROM anchored WHERE image IS NOT NULL AND image NOT IN (SELECT name FROM files)")(
    lambda s, d: S.missing(view(s, d, "anchored").where("image IS NOT NULL").select(F.col("image").alias("name")).distinct(), view(s, d, "files"), "name")
)

_add("D1_count_questions", "SELECT count(*) AS n FROM bank")(lambda s, d: _bank(s, d).agg(F.count("*").alias("n")))
_add("D2_list_subjects", "SELECT subject, count(*) AS n FROM bank GROUP BY subject")(lambda s, d: B.subjects(_bank(s, d)))
_DIM = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(QTYPES)) + ") dim(pos, qtype)"
_add("D3_list_qtypes", f"SELECT pos, dim.qtype, {_LABEL.format('dim.qtype')} AS label, coalesce(n, 0) AS n FROM {_DIM} LEFT JOIN (SELECT qtype, count(*) AS n FROM {_OWN} WHERE subject = 'src0' GROUP BY qtype) c ON c.qtype = dim.qtype")(
    lambda s, d: B.qtype_counts(B.matching(_bank(s, d), "src0"))
)
_add("D4_stats", f"""SELECT subject, qtype, count(*) AS n, count(*) FILTER (pending_review) AS n_pending,
 CASE WHEN grouping(subject, qtype) = 3 THEN (SELECT count(DISTINCT paper_id) FROM submissions) ELSE 0 END AS n_records FROM {_OWN} GROUP BY GROUPING SETS ((), (subject), (qtype))""")(
    lambda s, d: B.stats(_bank(s, d), view(s, d, "submissions").select("paper_id").distinct())
)
_OUTCOME = f"(SELECT *, CASE WHEN content_hash IN (SELECT content_hash FROM {_OWN}) OR row_number() OVER (PARTITION BY content_hash ORDER BY seq) > 1 THEN 'merged' ELSE 'inserted' END AS outcome FROM {_BATCH})"
_add("D5_import_summary", f"SELECT qtype, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'merged') AS merged, count(*) FILTER (pending_review) AS pending, count(*) AS total FROM {_OUTCOME} GROUP BY qtype")(
    lambda s, d: B.import_summary(B.outcomes(_bank(s, d), _batch(s, d)))
)
_add("D8_image_stats", f"""SELECT (SELECT count(*) FROM anchored) AS total, (SELECT count(image) FROM anchored) AS with_field, (SELECT count(*) FROM anchored WHERE question LIKE '%【图:%】%') AS with_anchor,
 (SELECT count(*) FROM {_REFS} WHERE name NOT IN (SELECT name FROM files)) AS missing, (SELECT count(*) FROM files WHERE name NOT IN (SELECT name FROM {_REFS})) AS orphans,
 (SELECT string_agg(name, ',' ORDER BY name) FROM (SELECT DISTINCT name FROM {_REFS} WHERE name NOT IN (SELECT name FROM files) ORDER BY name LIMIT 50)) AS missing_first,
 (SELECT string_agg(name, ',' ORDER BY name) FROM (SELECT name FROM files WHERE name NOT IN (SELECT name FROM {_REFS}) ORDER BY name LIMIT 50)) AS orphans_first""")(
    lambda s, d: L.image_stats(view(s, d, "anchored"), view(s, d, "files")).withColumns({c: F.array_join(c, ",") for c in ("missing_first", "orphans_first")})
)
_CLASSED = "(SELECT event_type AS kind, CASE event_id % 4 WHEN 1 THEN '' WHEN 2 THEN concat('timeout ', event_id % 7) WHEN 3 THEN concat('no reply: ', event_type) END AS error FROM events)"
_add("D9_kind_error_freq", f"SELECT 'kind' AS what, kind AS value, count(*) AS n FROM {_CLASSED} GROUP BY kind UNION ALL SELECT 'error', error, count(*) FROM {_CLASSED} WHERE error <> '' GROUP BY error")(
    lambda s, d: L.kinds_and_errors(view(s, d, "events").selectExpr("event_type AS kind", "CASE event_id % 4 WHEN 1 THEN '' WHEN 2 THEN concat('timeout ', event_id % 7) WHEN 3 THEN concat('no reply: ', event_type) END AS error"))
)
_add("D10_decorative_by_freq", "SELECT doc, fname AS image, count(DISTINCT page) AS n FROM marks WHERE fname IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT page) >= 2")(
    lambda s, d: L.decorative(view(s, d, "marks").where("fname IS NOT NULL").select("doc", F.col("fname").alias("image"), F.col("page").alias("para")), 2)
)

_add("E4_first_per_key", "SELECT question, min(id) AS id FROM bank GROUP BY question")(lambda s, d: B.first_per_key(_bank(s, d).select("id", "question"), "question", "id"))
_add("E5_gap_clusters", """WITH n AS (SELECT *, CASE WHEN y0 - lag(y0) OVER w >= 25 THEN 1 ELSE 0 END AS new FROM boxes WINDOW w AS (PARTITION BY doc ORDER BY y0, x0, event_id)),
 c AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY y0, x0, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM n)
 SELECT doc, cluster::BIGINT AS cluster, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM c GROUP BY doc, cluster
 HAVING max(x1) - min(x0) >= 8 AND max(y1) - min(y0) >= 8 AND (max(x1) - min(x0)) * (max(y1) - min(y0)) >= 400""")(lambda s, d: L.clusters(view(s, d, "boxes")))

_add("F1_page", f"SELECT {_LIST} FROM {_OWN} ORDER BY id DESC LIMIT 20 OFFSET 20")(lambda s, d: B.page(_bank(s, d), 2, 20).select(*_COLUMNS))
_RANK = "row_number() OVER (PARTITION BY {0} ORDER BY md5(concat('42:', cast(id AS VARCHAR))), id)"
_add("F2_random_sample", f"SELECT subject, id, rank FROM (SELECT subject, id, {_RANK.format('subject')} AS rank FROM bank) WHERE rank <= 5")(
    lambda s, d: B.sampled(_bank(s, d), ["subject"], 5).select("subject", "id", "rank")
)
_add("F3_reading_order", "SELECT doc, event_id, row_number() OVER (PARTITION BY doc ORDER BY y0, x0, event_id) AS pos FROM boxes")(
    lambda s, d: view(s, d, "boxes").selectExpr("doc", "event_id", "row_number() OVER (PARTITION BY doc ORDER BY bround(y0, 1), x0, event_id) AS pos")
)
_add("F4_caps", "SELECT id, len(string_split(question, ' ')[1:8]) AS n FROM bank")(lambda s, d: view(s, d, "bank").select("id", F.size(F.slice(F.split("question", " "), 1, 8)).cast("long").alias("n")))

_add("G1_dedup_exact", "SELECT min(id) AS id, question FROM bank GROUP BY question")(lambda s, d: B.first_per_key(_bank(s, d).select("id", "question"), "question", "id"))
# The bank and batch of full width. The oracle folds each fingerprint's rows one after the other.
_HASH_ALL = _HASH.format("question", "concat(replace(options, '|', ''), coalesce(answer, ''))")
_HELD, _ARRIVING = (f"(SELECT *, {_NORMAL.format('qtype_raw')} AS qtype, {_HASH_ALL} AS content_hash FROM {t})" for t in ("held", "arriving"))
_TURN = fold_sql(_HELD, _ARRIVING)


def _wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = view(spark, sf_dir, name).withColumns({"qtype": X.normalize_qtype(F.col("qtype_raw")), "options": F.split("options", "[|]")})
    return rows.withColumn("content_hash", X.content_hash(F.col("question"), F.col("answer"), F.col("options")))


def _written(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return U.upsert_batch(_wide(spark, sf_dir, "held"), _wide(spark, sf_dir, "arriving"))


_add("G2_upsert_dedup", f"""WITH {_TURN} SELECT content_hash, id, b.s AS subject, b.c AS course, b.t AS topic, b.k AS qtype, s.q AS question, s.a AS answer, s.o AS options, s.x AS explanation,
 s.p AS pending_review, files FROM m""")(
    lambda s, d: _written(s, d)[0].drop("qtype_raw").withColumns({c: F.array_join(c, sep) for c, sep in (("files", ","), ("options", "|"))})
)
_IMAGES = f"""WITH r AS (SELECT content_hash, id AS place, id, CASE WHEN id % 7 = 0 THEN concat('img', id % 210, '.png') END AS name FROM {_OWN} UNION ALL
 SELECT content_hash, 20000000000 + 2 * seq, NULL, concat('img', seq % 9, '.png') FROM {_BATCH} UNION ALL
 SELECT content_hash, 20000000001 + 2 * seq, NULL, concat('img', seq % 210, '.png') FROM {_BATCH}),
f AS (SELECT content_hash, name, min(place) AS place, min(id) AS id FROM r GROUP BY content_hash, name)
SELECT content_hash, coalesce(min(id), 0) AS id, coalesce(string_agg(name, ',' ORDER BY place), '') AS images FROM f GROUP BY content_hash"""
_add("G2_upsert_images", _IMAGES)(
    lambda s, d: U.upsert(
        _bank(s, d).withColumn("images", F.expr("if(id % 7 = 0, array(concat('img', id % 210, '.png')), NULL)")),
        _batch(s, d).withColumn("images", F.expr("array(concat('scan/', 'img', seq % 9, '.png'), concat('up', chr(92), 'img', seq % 210, '.png'))")),
    ).select("content_hash", F.coalesce("id", F.lit(0)).alias("id"), F.array_join("images", ",").alias("images"))
)
_add("G4_image_union", "SELECT id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(question, '【图:([^】]+)】', 1), CASE WHEN image IS NULL THEN [] ELSE [image] END))), ',') AS images FROM anchored")(
    lambda s, d: view(s, d, "anchored").select("id", F.array_join(F.array_sort(F.array_union(X.anchors(F.col("question")), F.filter(F.array("image"), lambda x: x.isNotNull()))), ",").alias("images"))
)
_add("G6_union_all", "SELECT question FROM bank UNION ALL SELECT question FROM incoming")(lambda s, d: view(s, d, "bank").select("question").unionByName(view(s, d, "incoming").select("question")))
_add("G7_distinct_ids", "SELECT DISTINCT question_id AS id FROM submissions WHERE question_id > 0")(lambda s, d: view(s, d, "submissions").where("question_id > 0").select(F.col("question_id").alias("id")).distinct())

_add("H1_content_hash", f"SELECT id, content_hash FROM {_OWN}")(lambda s, d: _bank(s, d).select("id", "content_hash"))


def _strings(values: Iterable[str]) -> str:
    return "string_split('" + "\u0001".join(values).replace("'", "''") + "', chr(1))"


def _unescaped(c: str) -> str:
    """SQL of one round of entity decoding, with all names of HTML."""
    names = {n: x for n, x in html5.items() if n.endswith(";")}
    of = lambda table, name: f"({_strings(table.values())})[list_position({_strings(table)}, {name})]"
    short = f"regexp_extract(x, '^&({'|'.join(X.SHORT_ENTITIES)})', 1)"
    hexes, digits = "regexp_extract(x, '^&#[xX]0*([0-9A-Fa-f]*)', 1)", "regexp_extract(x, '^&#0*([0-9]*)', 1)"
    number = f"CASE WHEN regexp_matches(x, '^&#[xX]') THEN CASE WHEN length({hexes}) <= 6 THEN cast('0x0' || {hexes} AS BIGINT) END WHEN length({digits}) <= 7 THEN cast('0' || {digits} AS BIGINT) END"
    char = f"""list_transform([{number}], lambda n: CASE WHEN n IS NULL OR n = 0 OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533) WHEN n BETWEEN 128 AND 159 THEN substr('{"".join(X.WINDOWS.values())}', n - 127, 1)
 WHEN n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n & 65534 = 65534 THEN '' ELSE chr(n::INT) END)[1]"""
    named = f"coalesce({of(names, 'substr(x, 2)')}, CASE WHEN {short} <> '' THEN {of(X.SHORT_ENTITIES, short)} || substr(x, length({short}) + 2) END, x)"
    tokens = rf"regexp_extract_all({c}, '(?s)(&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\t\n\f <&#;]{{1,32}};?|[^&]+|&)', 1)"
    return f"array_to_string(list_transform({tokens}, lambda x: CASE WHEN NOT starts_with(x, '&') OR x = '&' THEN x WHEN starts_with(x, '&#') THEN {char} ELSE {named} END), '')"


_ENTITIES = " &eacute; &amp;alpha;&le; &none; &copy 2020 &#150; &ltb &#0;"
_add("H2_html_unescape", f"""SELECT page_id, md5({_unescaped('once')}) AS text_md5 FROM (SELECT page_id, {_unescaped('given')} AS once FROM (SELECT page_id, html || '{_ENTITIES}' AS given FROM pages))""")(
    lambda s, d: view(s, d, "pages").select("page_id", F.md5(X.html_unescape(F.concat("html", F.lit(_ENTITIES)))).alias("text_md5"))
)
_add("H3_fix_private_use", "SELECT doc_id, md5(replace(text, '', 'α')) AS text_md5 FROM noisy")(lambda s, d: view(s, d, "noisy").select("doc_id", F.md5(X.fix_private_use(F.col("text"))).alias("text_md5")))
_add("H7_rule_clean", r"""SELECT doc_id, md5(replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^第\s*\d+\s*页\s*[/／]\s*共\s*\d+\s*页$')
 AND NOT regexp_matches(x, '^[-=—*_~]{5,}$')), chr(10)), '""" + "" + r"""', 'α')) AS text_md5 FROM noisy""")(lambda s, d: view(s, d, "noisy").select("doc_id", F.md5(X.rule_clean(F.col("text"))).alias("text_md5")))
# White space and line ends of functions/text.py in the classes of DuckDB's regular expressions.
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ENDS = r"\n-\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}"


def _share(part: str, whole: str) -> str:
    """SQL of a share; nothing has a share of 0."""
    return f"coalesce({part} / nullif({whole}, 0), 0)"


def _share9(part: str, whole: str) -> str:
    """SQL of a share rounded to nine digits, halves up: in whole numbers, as the product of a double and 1e9 may miss a half."""
    return f"coalesce(((2000000000 * {part} + {whole}) // nullif(2 * {whole}, 0)) / 1e9, 0)"


_TOKENS = f"list_filter(regexp_split_to_array(text, '[{_SPACE}]+'), lambda t: t <> '')"
_SINGLES = f"len(list_filter({_TOKENS}, lambda t: length(t) <= 1 AND NOT regexp_matches(t, '^[一-鿿$]')))"
_SINGLE = _share(_SINGLES, f"len({_TOKENS})")
_BLANK = f"NOT coalesce(regexp_matches(text, '[^{_SPACE}]'), false)"
_PUA = "len(regexp_extract_all(text, '[-]'))"
_LINES = rf"list_filter(regexp_split_to_array(text, '[{_ENDS}]'), lambda x: regexp_matches(x, '[^{_SPACE}]'))"
_CJK_LINES = f"len(list_filter({_LINES}, lambda x: regexp_matches(x, '[一-鿿]{{4,}}')))"
_CJK = _share(_CJK_LINES, f"len({_LINES})")
_add("H8_single_char_ratio", f"SELECT doc_id, {_share9(_SINGLES, f'len({_TOKENS})')} AS ratio FROM noisy")(lambda s, d: view(s, d, "noisy").select("doc_id", F.round(X.single_char_ratio(F.col("text")), 9).alias("ratio")))
_add("H10_pua_count", f"SELECT doc_id, {_PUA} AS n FROM noisy")(lambda s, d: view(s, d, "noisy").select("doc_id", X.private_use_count(F.col("text")).alias("n")))
_add("H11_cjk_line_ratio", f"SELECT doc_id, {_share9(_CJK_LINES, f'len({_LINES})')} AS ratio FROM noisy")(lambda s, d: view(s, d, "noisy").select("doc_id", F.round(X.cjk_line_ratio(F.col("text")), 9).alias("ratio")))
_SCORE = f"(CASE WHEN {_SINGLE} > 0.3 THEN 45 ELSE 0 END + CASE WHEN {_PUA} >= 1 THEN 30 ELSE 0 END + CASE WHEN len({_LINES}) > 5 AND {_CJK} < 0.25 THEN 25 ELSE 0 END)"
_WORSE = f"CASE WHEN {_BLANK} THEN 100 ELSE least({_SCORE}, 100) END"
_add("H12_quality_score", f"SELECT doc_id, round(s / 100.0, 3)::DOUBLE AS score, s >= 30 AS fragmented FROM (SELECT doc_id, {_WORSE} AS s FROM noisy)")(
    lambda s, d: view(s, d, "noisy").select("doc_id", X.quality_score(F.col("text")).alias("q")).select("doc_id", "q.score", "q.fragmented")
)
_add("H15_anchors", "SELECT id, array_to_string(regexp_extract_all(question, '【图:([^】]+)】', 1), ',') AS names FROM anchored")(lambda s, d: view(s, d, "anchored").select("id", F.array_join(X.anchors(F.col("question")), ",").alias("names")))
_add("H34_image_kind", "SELECT event_id, CASE WHEN y1 - y0 <= 40 AND x1 - x0 <= 80 THEN 'symbol' WHEN y1 - y0 <= 120 AND y1 > y0 AND (x1 - x0) / (y1 - y0) >= 3 THEN 'formula' ELSE 'diagram' END AS kind FROM boxes")(
    lambda s, d: view(s, d, "boxes").select("event_id", L.image_kind(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit("")).alias("kind"))
)
_add("H35_image_status", "SELECT event_id, CASE WHEN value < 5 AND event_id % 16 < 8 THEN 'black' WHEN value >= 128 THEN 'kept' ELSE 'normalized' END AS status FROM events")(
    lambda s, d: view(s, d, "events").select("event_id", L.image_status(F.col("value"), F.col("event_id") % 16).alias("status"))
)
_add("H36_page_image_filter", "SELECT event_id FROM boxes WHERE NOT (x1 - x0 >= 0.85 * 40 AND y1 - y0 >= 0.85 * 30)")(
    lambda s, d: view(s, d, "boxes").where(~L.covers_page(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(40.0), F.lit(30.0))).select("event_id")
)

_UPPER = "list_filter(regexp_extract_all(upper(u), '[A-Z]'), lambda x: x <> '')"
_NORMALISED = f"""CASE qtype WHEN 'judge' THEN CASE WHEN u IN {A.RIGHT} THEN '对' WHEN u IN {A.WRONG} THEN '错' ELSE u END
 WHEN 'multiple_choice' THEN array_to_string(list_sort(list_distinct({_UPPER})), '') WHEN 'single_choice' THEN CASE WHEN regexp_matches(upper(u), '^[A-Z]') THEN substring(upper(u), 1, 1) ELSE u END ELSE u END"""
_SUBMITTED = f"(SELECT s.*, b.qtype, trim(b.answer) AS r, trim(s.user_answer) AS u FROM (SELECT paper_id, question_id, arg_max(user_answer, event_id) AS user_answer FROM submissions GROUP BY 1, 2) s JOIN {_OWN} b ON b.id = s.question_id)"
_add("H17_normalize_answer", f"SELECT event_id, {_NORMALISED} AS answer FROM (SELECT s.event_id, b.qtype, trim(s.user_answer) AS u FROM submissions s JOIN {_OWN} b ON b.id = s.question_id)")(
    lambda s, d: view(s, d, "submissions").join(_bank(s, d).select(F.col("id").alias("question_id"), "qtype"), "question_id").select("event_id", A.normalize_answer(F.col("user_answer"), F.col("qtype")).alias("answer"))
)
_NORMAL_R = _NORMALISED.replace("upper(u)", "upper(r)").replace("u IN", "r IN").replace("ELSE u", "ELSE r")
_NUMBER = "CASE WHEN {0} LIKE '%/%' THEN try_cast(split_part({0}, '/', 1) AS DOUBLE) / try_cast(split_part({0}, '/', 2) AS DOUBLE) ELSE try_cast({0} AS DOUBLE) END"
_PARTS = "array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array({0}, '[,，、;；]'), lambda x: lower(trim(x))), lambda x: x <> '')), '|')"
_STATUS = f"""CASE WHEN r = '' OR r LIKE '%（待补充答案）%' OR qtype IN ('essay', 'thinking') THEN 'pending' WHEN ({_NORMALISED}) = '' THEN 'wrong'
 WHEN qtype = 'calc' THEN CASE WHEN abs(({_NUMBER.format('u')}) - ({_NUMBER.format('r')})) <= greatest(5e-4 * greatest(abs({_NUMBER.format('u')}), abs({_NUMBER.format('r')})), 1e-6) THEN 'correct' ELSE 'wrong' END
 WHEN qtype = 'blank' THEN CASE WHEN {_PARTS.format('u')} = {_PARTS.format('r')} THEN 'correct' ELSE 'wrong' END
 WHEN ({_NORMALISED}) = ({_NORMAL_R}) THEN 'correct' ELSE 'wrong' END"""
_add("H22_check_answer", f"SELECT paper_id, question_id, {_STATUS} AS status FROM {_SUBMITTED}")(
    lambda s, d: P.grade(_bank(s, d), view(s, d, "submissions")).select("paper_id", "question_id", "status")
)
_add("I10_grade", f"""SELECT *, CASE WHEN n_pending > 0 THEN 'pending' ELSE 'graded' END AS status FROM (SELECT paper_id, 10 * count(*) FILTER (st = 'correct') AS score, count(*) FILTER (st = 'correct') AS n_correct,
 count(*) FILTER (st = 'wrong') AS n_wrong, count(*) FILTER (st = 'pending') AS n_pending FROM (SELECT paper_id, {_STATUS} AS st FROM {_SUBMITTED}) GROUP BY paper_id)""")(
    lambda s, d: P.rollup(P.grade(_bank(s, d), view(s, d, "submissions")))
)
_add("I8_practice", f"SELECT subject, rank, id, 10 AS points FROM (SELECT subject, id, {_RANK.format('subject')} AS rank FROM {_OWN} WHERE qtype = 'single_choice') WHERE rank <= 5")(
    lambda s, d: P.practice(_bank(s, d), 5, "single_choice")
)


def _sections(spark, sf) -> DataFrame:
    """A paper for each subject (and one for all), with a section of each of three types."""
    papers = _bank(spark, sf).select("subject").distinct().union(spark.sql("SELECT ''"))
    return papers.select(F.col("subject").alias("paper"), "subject", F.expr("stack(3, 0, 'single_choice', 4, 5.0D, 1, 'blank', 2, 10.0D, 2, 'calc', 0, 20.0D) AS (pos, qtype, count, score)"))


_SECTIONS = "(SELECT s.subject AS paper, s.subject, t.* FROM (SELECT DISTINCT subject FROM bank UNION ALL SELECT '') s, (VALUES (0, 'single_choice', 4, 5.0::DOUBLE), (1, 'blank', 2, 10.0::DOUBLE), (2, 'calc', 0, 20.0::DOUBLE)) t(pos, qtype, count, score))"
_PICKED = f"(SELECT * FROM (SELECT s.paper, s.pos, s.qtype, s.count, s.score, b.id, {_RANK.format('s.paper, s.pos').replace('(id', '(b.id').replace(', id', ', b.id').replace('cast(id', 'cast(b.id')} AS rank FROM {_SECTIONS} s JOIN {_OWN} b ON b.qtype = s.qtype AND (s.subject = '' OR s.subject = b.subject) WHERE s.count > 0) WHERE rank <= count)"
_add("I9_build_paper", f"SELECT paper, pos, qtype, rank, id, score FROM {_PICKED}")(lambda s, d: P.build(_bank(s, d), _sections(s, d)))
_add("D7_paper_totals", f"SELECT paper, count(*) AS question_count, sum(score) AS total_score FROM {_PICKED} GROUP BY paper")(lambda s, d: P.totals(P.build(_bank(s, d), _sections(s, d))))
_add("I13_similar_index", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS norm, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS first FROM embeddings")(
    lambda s, d: S.index(view(s, d, "embeddings")).select("vec_id", F.round("norm", 9).alias("norm"), F.round(F.col("unit")[0], 9).alias("first"))
)
_add("entry_type_distribution", f"SELECT pos, dim.qtype, {_LABEL.format('dim.qtype')} AS label, coalesce(n, 0) AS n FROM {_DIM} LEFT JOIN (SELECT qtype, count(*) AS n FROM (SELECT content_hash, arg_min(qtype, id) AS qtype FROM {_OWN} GROUP BY content_hash) GROUP BY qtype) c ON c.qtype = dim.qtype")(
    lambda s, d: B.qtype_counts(B.first_per_key(_bank(s, d).select("id", "qtype", "content_hash"), "content_hash", "id"))
)

# Records, images and their classes.
_RECORDS = f"""(SELECT *, CASE WHEN n_pending > 0 THEN 'pending' ELSE 'graded' END AS status FROM (SELECT paper_id AS id, count(*) FILTER (st = 'correct') AS n_correct,
 count(*) FILTER (st = 'pending') AS n_pending FROM (SELECT paper_id, {_STATUS} AS st FROM {_SUBMITTED}) GROUP BY paper_id))"""
_add("B5_list_records", f"SELECT id, n_correct, n_pending FROM {_RECORDS} WHERE status = 'pending' ORDER BY id DESC LIMIT 50")(
    lambda s, d: B.page(P.rollup(P.grade(_bank(s, d), view(s, d, "submissions"))).where("status = 'pending'").withColumnRenamed("paper_id", "id"), 1, 50).select("id", "n_correct", "n_pending")
)
_add("B15_set_images", "SELECT a.id, CASE WHEN i.seq IS NULL THEN coalesce(a.image, '') ELSE concat(i.source_file, ',img1.png') END AS images FROM anchored a LEFT JOIN incoming i ON i.seq = a.id")(
    lambda s, d: B.set_images(
        view(s, d, "anchored").select("id", F.array_compact(F.array("image")).alias("images")),
        _batch(s, d).select(F.col("seq").alias("id"), F.array(F.concat(F.lit("dir/"), "source_file"), F.lit("a\\b/img1.png"), F.lit("x/..")).alias("images")),
    ).select("id", F.array_join("images", ",").alias("images"))
)
_NUMBERED = "(SELECT doc, event_id, fname, question FROM (SELECT *, last_value(key IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, y, kind, event_id ROWS UNBOUNDED PRECEDING) AS question FROM marks) WHERE kind = 1)"
_KEYS = "(SELECT DISTINCT doc, key FROM marks WHERE kind = 0)"


def _keys(spark, sf) -> DataFrame:
    return view(spark, sf, "marks").where("kind = 0").select("doc", "key").distinct()


_PAIRED = "SELECT i.doc, q.key, i.fname{3} FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY event_id) AS nth FROM {0}) i {2} JOIN (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY try_cast(key AS INT), key) AS nth FROM {1}) q ON q.doc = i.doc AND q.nth = i.nth"
# Every seventh image carries a number that no question has.
_BINDING = f"""i AS (SELECT doc, event_id, fname, CASE WHEN event_id % 7 = 0 THEN '99' ELSE question END AS key FROM {_NUMBERED}),
l AS (SELECT doc, key, string_agg(concat('【图:', fname, '】'), ' ' ORDER BY event_id) AS anchors, count(*) AS n, min(event_id) AS first FROM i WHERE key IS NOT NULL GROUP BY 1, 2),
q AS (SELECT k.doc, k.key, concat_ws(' ', concat('item ', k.key), anchors) AS question, coalesce(n, 0) AS matched FROM {_KEYS} k LEFT JOIN l ON l.doc = k.doc AND l.key = k.key),
w AS (SELECT doc, fname, row_number() OVER (PARTITION BY doc ORDER BY g, first, event_id) AS nth, doc IN (SELECT doc FROM l) AS takes FROM (
  SELECT doc, fname, event_id, 0 AS g, 0 AS first FROM i WHERE key IS NULL UNION ALL SELECT i.doc, fname, event_id, 1, first FROM i JOIN l ON l.doc = i.doc AND l.key = i.key
   WHERE NOT EXISTS (SELECT 1 FROM {_KEYS} k WHERE k.doc = i.doc AND k.key = i.key))),
f AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY cast(key AS INT)) AS nth FROM q WHERE matched = 0),
p AS (SELECT f.doc, f.key, w.fname, w.nth FROM f JOIN w ON w.doc = f.doc AND w.nth = f.nth AND takes)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir).select("doc", F.col("key").cast("int").alias("qnum"), F.col("key").cast("int").alias("pos"), F.concat(F.lit("item "), "key").alias("question"), F.lit(False).alias("pending_review"))


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("event_id") % 7 == 0, "99").otherwise(F.col("question"))
    return L.attribute(view(spark, sf_dir, "marks")).select("doc", F.col("event_id").alias("place"), F.col("fname").alias("name"), key.alias("key"))


_add("C3_image_by_qnum", f"WITH {_BINDING} SELECT doc, key, question, matched FROM q")(
    lambda s, d: K.bind_by_number(_asked(s, d), _shown(s, d), "doc").select("doc", F.col("qnum").cast("string").alias("key"), "question", F.col("matched").cast("long").alias("matched"))
)
_add("C4_image_sequential", f"WITH {_BINDING} SELECT q.doc, q.key, concat_ws(' ', q.question, '【图:' || p.fname || '】') AS question, p.fname IS NOT NULL AS pending_review FROM q LEFT JOIN p ON p.doc = q.doc AND p.key = q.key")(
    lambda s, d: K.bind(_asked(s, d), _shown(s, d), "doc").questions.select("doc", F.col("qnum").cast("string").alias("key"), "question", "pending_review")
)
_add("C4_image_counts", f"""WITH {_BINDING}, d AS (SELECT doc FROM q UNION SELECT doc FROM w), o AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc = w.doc AND p.nth = w.nth))
 SELECT doc, (SELECT coalesce(sum(matched), 0) FROM q WHERE q.doc = d.doc)::BIGINT AS certain, (SELECT count(*) FROM p WHERE p.doc = d.doc) AS uncertain, (SELECT count(*) FROM o WHERE o.doc = d.doc) AS leftover,
  coalesce((SELECT string_agg(fname, ',' ORDER BY nth) FROM o WHERE o.doc = d.doc), '') AS names FROM d""")(
    lambda s, d: (lambda b: b.counts.join(b.leftovers.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "name"))), lambda x: x["name"]), ",").alias("names")), "doc", "left").na.fill("", ["names"]))(
        K.bind(_asked(s, d), _shown(s, d), "doc"))
)
_add("C5_image_zip", _PAIRED.format(_NUMBERED, _KEYS, "", ""))(lambda s, d: L.pair_in_order(L.attribute(view(s, d, "marks")), _keys(s, d)))
_CLASSES = "(SELECT name, n, CASE n % 3 WHEN 0 THEN 'formula' WHEN 1 THEN 'decorative' ELSE 'diagram' END AS kind FROM (SELECT name, cast(regexp_extract(name, '[0-9]+', 0) AS BIGINT) AS n FROM files))"
_NAMED = "(SELECT *, regexp_extract(question, '【图:([^】]+)】', 1) AS name FROM anchored)"
_add("C7_image_class_rewrite", f"SELECT a.id, CASE c.kind WHEN 'formula' THEN replace(question, concat('【图:', a.name, '】'), concat('$x_{{', c.n, '}}$')) WHEN 'decorative' THEN replace(question, concat('【图:', a.name, '】'), '') ELSE question END AS question FROM {_NAMED} a LEFT JOIN {_CLASSES} c ON c.name = a.name")(
    lambda s, d: L.rewrite_by_class(
        view(s, d, "anchored"),
        view(s, d, "files").withColumn("n", F.regexp_extract("name", "[0-9]+", 0).cast("long")).select(
            "name", F.when(F.col("n") % 3 == 0, "formula").when(F.col("n") % 3 == 1, "decorative").otherwise("diagram").alias("kind"), F.concat(F.lit("x_{"), "n", F.lit("}")).alias("latex")
        ),
    ).select("id", "question")
)
_add("H16_image_context", f"SELECT name, arg_min(substring(question, 1, 80), id) AS context FROM {_NAMED} WHERE name <> '' GROUP BY name")(lambda s, d: L.image_context(view(s, d, "anchored")))
_listed = lambda status: f"coalesce(string_agg(cast(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER ({status}), '')"
_BLACK = "value < 5 AND event_id % 16 < 8"
_add("I14_image_prep", f"SELECT user_id AS doc, {_listed('value >= 128')} AS usable, {_listed(_BLACK)} AS skipped, {_listed(f'value < 128 AND NOT ({_BLACK})')} AS normalized FROM events GROUP BY user_id")(
    lambda s, d: L.image_lists(view(s, d, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("name"), L.image_status(F.col("value"), F.col("event_id") % 16).alias("status"))).select(
        "doc", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("usable", "skipped", "normalized")]
    )
)

# Lines, texts and replies.
_EXAM_LINES = "(SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM exam))"
_add("E2_carry_forward", f"SELECT doc_id, pos, last_value(CASE WHEN regexp_matches(line, '^[一二三]、') THEN substring(line, 3) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM {_EXAM_LINES}")(
    lambda s, d: N.carry_forward(N.numbered(view(s, d, "exam")), F.when(F.col("line").rlike("^[一二三]、"), F.expr("substring(line, 3)")), "section").select("doc_id", "pos", "section")
)
_add("E3_block_id", rf"SELECT doc_id, pos, cast(sum(CASE WHEN regexp_matches(line, '^[0-9]+\. ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM {_EXAM_LINES}")(
    lambda s, d: N.block_ids(N.numbered(view(s, d, "exam")), F.col("line").rlike(r"^[0-9]+\. ")).select("doc_id", "pos", "block")
)
_add("D11_quality_profile", f"SELECT doc_id, len({_LINES}) AS n_lines, len({_TOKENS}) AS n_tokens FROM noisy")(
    lambda s, d: view(s, d, "noisy").select("doc_id", X.line_count(F.col("text")).alias("n_lines"), X.token_count(F.col("text")).alias("n_tokens"))
)
_KNOWN = ", ".join(f"'{x}'" for x in sorted({k.lower() for k in X.KNOWN_COMMANDS}))
_add("H9_broken_latex_count", rf"SELECT doc_id, len(list_filter(regexp_extract_all(text, '\\([a-zA-Z]{{2,}})\s+[a-zA-Z]', 1), lambda x: lower(x) NOT IN ({_KNOWN}))) AS n FROM latexed")(
    lambda s, d: view(s, d, "latexed").select("doc_id", X.broken_commands(F.col("text")).alias("n"))
)
_add("H23_verdict_parse", """SELECT event_id, CASE WHEN regexp_matches(line, '不正确|不完全对|不完全|错误|错|否|×') THEN 'false' WHEN regexp_matches(line, '正确|对|√|是') THEN 'true' END AS verdict
 FROM (SELECT event_id, list_filter(list_transform(string_split(reply, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS line FROM replies)""")(
    lambda s, d: view(s, d, "replies").select("event_id", A.verdict(F.col("reply")).cast("string").alias("verdict"))
)
_add("H38_paper_id_time", "SELECT event_id, concat('P', strftime(ts, '%Y%m%d%H%M%S'), substring(md5(cast(event_id AS VARCHAR)), 1, 4)) AS paper_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events")(
    lambda s, d: view(s, d, "events").select("event_id", P.paper_id(F.col("ts"), F.col("event_id")).alias("paper_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
)
_add("I12_ocr_choice", f"""SELECT n.doc_id, CASE WHEN n.s < 30 THEN 'kept' WHEN trim(d.text) <> '' AND d.s < n.s THEN 'replaced' ELSE 'rejected' END AS outcome
 FROM (SELECT doc_id, {_WORSE} AS s FROM noisy) n JOIN (SELECT doc_id, text, {_WORSE} AS s FROM documents) d ON d.doc_id = n.doc_id""")(
    lambda s, d: X.choose_text(view(s, d, "noisy").join(view(s, d, "documents").select("doc_id", F.col("text").alias("other")), "doc_id"), "text", "other").select("doc_id", "outcome")
)
_add("I15_import_variants", f"SELECT seq, coalesce(nullif(trim(subject), ''), '默认') AS subject, '变式生成' AS source_file, outcome FROM {_OUTCOME}")(
    lambda s, d: B.outcomes(_bank(s, d), B.variants(_batch(s, d).drop("source_file"))).select("seq", "subject", "source_file", "outcome")
)


def _answered(spark, sf, *kinds: str) -> DataFrame:
    own = _bank(spark, sf).where(F.col("qtype").isin(*kinds)).select(F.col("id").alias("question_id"), "qtype", "answer")
    return A.check_answers(P.last_answers(view(spark, sf, "submissions")).join(own, "question_id"), "user_answer", "answer").select("paper_id", "question_id", "ok")


_ok = lambda test, types: f"SELECT paper_id, question_id, r <> '' AND ({_NORMALISED}) <> '' AND coalesce({test}, false) AS ok FROM {_SUBMITTED} WHERE qtype IN {types}"
_add("H18_check_choice", _ok(f"({_NORMALISED}) = ({_NORMAL_R})", "('single_choice', 'multiple_choice')"))(lambda s, d: _answered(s, d, "single_choice", "multiple_choice"))
_U, _R = _NUMBER.format("u"), _NUMBER.format("r")
_add("H20_check_calc", _ok(f"abs(({_U}) - ({_R})) <= greatest(5e-4 * greatest(abs({_U}), abs({_R})), 1e-6)", "('calc')"))(lambda s, d: _answered(s, d, "calc"))
_add("H21_check_blank", _ok(f"{_PARTS.format('u')} = {_PARTS.format('r')}", "('blank')"))(lambda s, d: _answered(s, d, "blank"))


# Items of 0.125 to 1.0 points, so that sums are exact and often half a hundredth.
_add("D6_grade_rollup", f"""SELECT paper_id, round_even(coalesce(sum((question_id % 8 + 1) * 0.125::DOUBLE) FILTER (st = 'correct'), 0), 2)::DOUBLE AS score, count(*) FILTER (st = 'correct') AS n_correct, count(*) FILTER (st = 'wrong') AS n_wrong,
 count(*) FILTER (st = 'pending') AS n_pending, CASE WHEN count(*) FILTER (st = 'pending') > 0 THEN 'pending' ELSE 'graded' END AS status
 FROM (SELECT paper_id, question_id, {_STATUS} AS st FROM {_SUBMITTED}) GROUP BY paper_id""")(
    lambda s, d: P.rollup(P.grade(_bank(s, d), view(s, d, "submissions")), (F.col("question_id") % 8 + 1) * F.lit(0.125))
)
_add("E1_item_number", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, md5(list_extract(l, i)) AS line_md5 FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")(
    lambda s, d: N.numbered(view(s, d, "documents")).select("doc_id", (F.col("pos") + 1).alias("n"), F.md5("line").alias("line_md5"))
)
_add("G3_upsert_batch", f"WITH {_TURN} SELECT r.seq, m.id, CASE WHEN new AND r.seq = m.first THEN 'inserted' ELSE 'merged' END AS outcome FROM r JOIN m USING (content_hash) WHERE part = 1")(
    lambda s, d: _written(s, d)[1]
)
_add("G5_append_source", f"""WITH a AS (SELECT content_hash, source_file, min(seq) AS seq FROM {_ARRIVING} WHERE source_file <> '' GROUP BY 1, 2),
l AS (SELECT content_hash, list(source_file ORDER BY seq) AS files FROM a GROUP BY 1), p AS (SELECT content_hash, bool_or(pending_review) AS waits FROM {_ARRIVING} GROUP BY 1)
 SELECT h.id, array_to_string(list_concat([h.source_file], list_filter(coalesce(files, []), lambda f: f <> h.source_file)), ',') AS files, h.pending_review OR coalesce(waits, false) AS pending_review
 FROM {_HELD} h LEFT JOIN l USING (content_hash) LEFT JOIN p USING (content_hash)""")(
    lambda s, d: U.append_sources(
        _wide(s, d, "held").select("id", "content_hash", F.array("source_file").alias("files"), "pending_review"), _wide(s, d, "arriving")
    ).select("id", F.array_join("files", ",").alias("files"), "pending_review")
)


_BROKEN = rf"len(list_filter(regexp_extract_all(text, '\\([a-zA-Z]{{2,}})\s+[a-zA-Z]', 1), lambda x: lower(x) NOT IN ({_KNOWN})))"
_add("H12_quality_commands", f"""SELECT doc_id, round(s / 100.0, 3)::DOUBLE AS score, s >= 30 AS fragmented, n::BIGINT AS n_reasons FROM (
 SELECT doc_id, CASE WHEN {_BLANK} THEN 100 ELSE least({_SCORE} + CASE WHEN {_BROKEN} >= 2 THEN 35 ELSE 0 END, 100) END AS s,
  CASE WHEN {_BLANK} THEN 1 ELSE ({_SINGLE} > 0.3)::INT + ({_PUA} >= 1)::INT + (len({_LINES}) > 5 AND {_CJK} < 0.25)::INT + ({_BROKEN} >= 2)::INT END AS n FROM latexed)""")(
    lambda s, d: view(s, d, "latexed").select("doc_id", X.quality_score(F.col("text")).alias("q")).select("doc_id", "q.*")
)


# Sources and sinks, through folders of their own.
def _folder(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


@F.pandas_udf(BinaryType())
def _gb18030(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t.encode("gb18030"))


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a line of a text file: in UTF-8, in GB18030, or with a byte that neither has."""
    line = F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\u2424")))
    rows = view(spark, sf_dir, "documents").select((F.col("doc_id") % 3).alias("enc"), line.alias("line"))
    data = F.when(F.col("enc") == 0, F.encode("line", "UTF-8")).when(F.col("enc") == 1, _gb18030(F.concat(F.lit("题目"), "line"))).otherwise(F.concat(F.unhex(F.lit("FF")), F.encode("line", "UTF-8")))
    rows.select("enc", data.cast("string").alias("value")).write.partitionBy("enc").option("maxRecordsPerFile", 200).text(path := _folder(spark, "texts"))
    found = T.read_texts(spark, path).select("encoding", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    parts = F.split(F.regexp_replace("line", "^(题目|\ufffd)", ""), "\t", 2)
    return found.select(parts[0].cast("long").alias("doc_id"), "encoding", F.md5(F.replace(parts[1], F.lit("\u2424"), F.lit("\n"))).alias("text_md5"))


_add("A2_decode_text", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'gb18030' ELSE 'replaced' END AS encoding, md5(coalesce(text, '')) AS text_md5 FROM documents")(_encoded)


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of all graded records as CSV, many records in a file, read again."""
    graded = P.grade(_bank(spark, sf_dir), view(spark, sf_dir, "submissions")).join(_bank(spark, sf_dir).select(F.col("id").alias("question_id"), "question"), "question_id")
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("question_id"))
    items = graded.select("paper_id", place.alias("n"), "question", F.col("answer").alias("correct_answer"), "user_answer", "status", F.when(F.col("status") == "correct", 10.0).otherwise(0.0).alias("score"), "comment")
    T.export_csv(items, path := _folder(spark, "records"), apart=False)
    return T.read_exported(spark, path, "paper_id long").select("paper_id", "n", F.md5("question").alias("question_md5"), "correct_answer", "user_answer", "status", "score")


_add("A4_export_csv", f"""SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY question_id) AS n, md5(question) AS question_md5, answer AS correct_answer, user_answer, st AS status, CASE st WHEN 'correct' THEN 10.0 ELSE 0.0 END::DOUBLE AS score
 FROM (SELECT *, {_STATUS} AS st FROM (SELECT s.*, b.qtype, b.question, b.answer, trim(b.answer) AS r, trim(s.user_answer) AS u FROM (SELECT paper_id, question_id, arg_max(user_answer, event_id) AS user_answer FROM submissions GROUP BY 1, 2) s JOIN {_OWN} b ON b.id = s.question_id))""")(_exported)


def _saved_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers as JSON files and one file that is no paper, read again."""
    items = P.build(_bank(spark, sf_dir), _sections(spark, sf_dir))
    papers = items.groupBy(F.concat(F.lit("P"), "paper").alias("id")).agg(
        F.sum("score").alias("total_score"), F.array_sort(F.collect_list(F.struct("pos", "rank", F.col("id").alias("question_id"), "score"))).alias("questions")
    )
    T.write_papers(papers, path := _folder(spark, "papers"))
    spark.range(1).select(F.lit("{no json").alias("value")).write.text(f"{path}/id=broken")
    found = T.read_papers(spark, path, "total_score double, questions array<struct<pos:int,rank:int,question_id:bigint,score:double>>")
    listed = T.list_papers(found).select("id", F.size("questions").cast("long").alias("question_count"), "total_score", F.array_join(F.transform("questions", lambda q: q["question_id"].cast("string")), ",").alias("ids"))
    return listed.unionByName(found.where("damaged IS NOT NULL").select("id", F.lit(-1).cast("long").alias("question_count"), F.lit(0.0).alias("total_score"), F.lit("").alias("ids")))


_add("A5_papers_json", f"SELECT concat('P', paper) AS id, count(*) AS question_count, sum(score) AS total_score, string_agg(cast(id AS VARCHAR), ',' ORDER BY pos, rank) AS ids FROM {_PICKED} GROUP BY paper UNION ALL SELECT 'broken', -1, 0, ''")(_saved_papers)


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in two batches, the first of them written twice."""
    records = P.rollup(P.grade(_bank(spark, sf_dir), view(spark, sf_dir, "submissions")))
    path = _folder(spark, "appended")
    for batch, rows in (("one", records.where("status = 'pending'")), ("two", records.where("status <> 'pending'")), ("one", records.where("status = 'pending'"))):
        T.append(rows, path, batch)
    return T.read_appended(spark, path).select("paper_id", "score", "n_correct", "n_wrong", "n_pending", "status")


_add("A6_append_records", f"""SELECT *, CASE WHEN n_pending > 0 THEN 'pending' ELSE 'graded' END AS status FROM (SELECT paper_id, 10 * count(*) FILTER (st = 'correct') AS score, count(*) FILTER (st = 'correct') AS n_correct,
 count(*) FILTER (st = 'wrong') AS n_wrong, count(*) FILTER (st = 'pending') AS n_pending FROM (SELECT paper_id, {_STATUS} AS st FROM {_SUBMITTED}) GROUP BY paper_id)""")(_appended)


def _image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the names in the table, those with odd numbers with another suffix than an image's; what is listed and what is referred to without a file."""
    names = view(spark, sf_dir, "files").withColumn("odd", F.regexp_extract("name", "[0-9]+", 0).cast("long") % 2 == 1)
    path = _folder(spark, "images")
    for suffix, rows in (("png", names.where("NOT odd")), ("doc", names.where("odd"))):
        rows.select("name", F.lit("x").alias("x")).write.mode("append").option("extension", suffix).partitionBy("name").csv(path)
    listed = T.list_images(spark, path).select(F.regexp_extract("path", "name=([^/]+)", 1).alias("name"))
    anchored = view(spark, sf_dir, "anchored")
    return listed.withColumn("state", F.lit("listed")).unionByName(L.missing_files(anchored, listed).withColumn("state", F.lit("missing"))).unionByName(L.orphan_files(anchored, listed).withColumn("state", F.lit("orphan")))


_LISTED = "(SELECT name FROM files WHERE cast(regexp_extract(name, '[0-9]+', 0) AS BIGINT) % 2 = 0)"
_add("A9_list_images", f"SELECT name, 'listed' AS state FROM {_LISTED} UNION ALL SELECT name, 'missing' FROM {_REFS} WHERE name NOT IN (SELECT name FROM {_LISTED}) UNION ALL SELECT name, 'orphan' FROM {_LISTED} WHERE name NOT IN (SELECT name FROM {_REFS})")(_image_files)


def queries() -> dict[str, Query]:
    return {**_QUERIES, **exam_queries.QUERIES, **import_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**_SQL, **exam_queries.SQL, **import_queries.SQL}
