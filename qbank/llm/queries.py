"""The queries of this subpackage, opN_<name>, over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann_pstable, byte_bpe, license_scan, merkle, near_dup_vectors, ngram_join, packing, pii, piece_dropout, quality, suffix_dedup, token_counts, whitening,
)

#: Where the public tokenizers' files are; nothing of them is part of the library.
WORD_TOKENIZER, PIECE_MODEL, BYTE_RANKS = "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_vector_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path(PIECE_MODEL)).drop("text")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir)).drop("text")


def op5_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_dropout.round_trip(_documents(spark, sf_dir), public_tokenizers.path(PIECE_MODEL))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_documents(spark, sf_dir)).drop("text")
    named = "transform({}, s -> concat_ws(':', s.kind, s.start, s.end))"
    base = "filter(pii, s -> s.base)"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(pii, s -> s.base AND s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.expr(f"sha2(array_join({named.format(base)}, ','), 256)").alias("base_sha256"),
        F.expr(f"array_join({named.format('pii')}, ',')").alias("spans"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_documents(spark, sf_dir), passages=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages")


def op8_ann_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann_pstable.search(vectors, vectors.where("vec_id % 20 = 0"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir)).drop("text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(_table(spark, sf_dir, "documents"), F.when(chosen, F.replace("text", F.lit("\n"), F.lit("")))).drop("siblings")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_vector_near_dups, op2_token_counts, op3_ngram_join, op4_license_scan, op5_piece_dropout, op6_pii,
            op7_suffix_dedup, op8_ann_pstable, op9_packing, op10_quality, op11_merkle_manifest, op12_whitening, op13_byte_bpe,
        )
    }


_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= {near_dup_vectors.COSINE}),
r AS (SELECT a AS s, a AS t FROM l UNION SELECT r.s, l.b FROM r JOIN l ON r.t = l.a),
c AS (SELECT s, min(t) AS m FROM r GROUP BY s),
n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, coalesce(m, vec_id) AS component_id, vec_id = coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.s = vec_id LEFT JOIN n ON n.a = vec_id
"""

_OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, {_WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - {ngram_join.WORDS - 1}, 1) + 1),
        lambda i: array_to_string(w[i:i + {ngram_join.WORDS - 1}], ' '))) AS g FROM w WHERE len(w) > 0),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
h AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 10 * k >= 8 * (x.n + y.n - k)),
l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r AS (SELECT a AS s, a AS t FROM l UNION SELECT r.s, l.b FROM r JOIN l ON r.t = l.a),
c AS (SELECT s, min(t) AS m FROM r GROUP BY s),
n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT doc_id, coalesce(k, 0) AS n_links, coalesce(m, doc_id) AS component_id, doc_id = coalesce(m, doc_id) AS kept
FROM documents LEFT JOIN c ON c.s = doc_id LEFT JOIN n ON n.a = doc_id
"""


def _license_sql() -> str:
    phrases = ", ".join(f"('{label}', {p.split()})" for p, label in license_scan.PHRASES.items())
    index = license_scan.Index({})
    needs = {label: need for label, _, need in index.templates}
    templates = ", ".join(f"('{label}', {sorted(w.decode() for w in held)}, {index.spans[label]}, {needs[label]})" for label, held in license_scan.template_words().items())
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOW}, {_WORDS}) AS w FROM documents),
p(label, phrase) AS (VALUES {phrases}),
t(label, held, span, need) AS (VALUES {templates}),
hits AS (SELECT doc_id, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(phrase) - 1] = phrase)) - 1 AS place FROM w, p),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM hits GROUP BY doc_id),
places AS (SELECT doc_id, w, label, held, span, need, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains(held, w[i]))) AS i FROM w, t WHERE len(list_intersect(held, w)) >= need),
found AS (SELECT doc_id, label, max(len(list_intersect(held, w[i:i + span - 1])) / len(held)) AS part FROM places WHERE len(list_intersect(held, w[i:i + span - 1])) >= need GROUP BY 1, 2),
named AS (SELECT doc_id, label, true AS is_base, 1.0 AS part FROM hits UNION ALL SELECT doc_id, label, false, part FROM found),
agg AS (SELECT doc_id, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base), '') AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(part) AS score FROM named GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN agg USING (doc_id)
"""


#: Bytes as two hex digits and a space each; those of a word are letters, digits and what is not ASCII.
_WORD_HEX = "(?:(?:3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|[89A-F][0-9A-F]) )+"


def _repeats_sql(length: int, n: str) -> str:
    """Tables w, r, i of windows, of those that are repeated, and of the islands (first, last byte + 1) that these cover."""
    return f"""
w{n} AS (SELECT doc_id, pos, md5(substr(h, 2 * pos + 1, {2 * length})) AS v FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {length - 1})) AS pos FROM d)),
r{n} AS (SELECT doc_id, pos FROM w{n} JOIN (SELECT v FROM w{n} GROUP BY v HAVING count(*) > 1) USING (v)),
i{n} AS (SELECT doc_id, min(pos) AS f, max(pos) + {length} AS e FROM (
  SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (
    SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= {length} THEN 0 ELSE 1 END AS new FROM r{n})) GROUP BY doc_id, island)"""


_OP7 = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),{_repeats_sql(suffix_dedup.LENGTH, "")},{_repeats_sql(suffix_dedup.PASSAGE, "p")},
s AS (SELECT doc_id, count(*) AS n_spans, sum(e - f) AS n_removed, list(f ORDER BY f) AS fs, list(e ORDER BY f) AS es FROM i GROUP BY doc_id),
p AS (SELECT doc_id, count(*) AS n FROM ip JOIN d USING (doc_id)
  WHERE len(regexp_extract_all(regexp_replace(substr(h, 2 * f + 1, 2 * (e - f)), '(..)', '\\1 ', 'g'), '{_WORD_HEX}')) >= {suffix_dedup.PASSAGE_WORDS} GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, n_spans + 1), lambda k:
    substr(h, 2 * (CASE WHEN k = 0 THEN 0 ELSE es[k] END) + 1, 2 * (coalesce(fs[k + 1], len(h) // 2) - CASE WHEN k = 0 THEN 0 ELSE es[k] END))), '') END)) AS kept_sha256,
  coalesce(n, 0)::BIGINT AS n_passages
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN p USING (doc_id)
"""


def _leaf_sql(text: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(concat(strlen(cast({c} AS VARCHAR)), ':', {c}), '-')" for c in (*merkle.COLUMNS[:-1], text)) + "))"


#: The check sum of a decimal number, byte by byte and bit by bit, without its last inversion.
_CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(cast(doc_id AS VARCHAR)) + 1), lambda i: ascii(substr(cast(doc_id AS VARCHAR), i, 1))::BIGINT)),
 lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""

_OP11 = f"""
WITH RECURSIVE f AS (SELECT *, CASE WHEN {_CRC} % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents),
h AS (SELECT doc_id, coalesce(concat('+', source), '') AS src, {_leaf_sql('text')} AS leaf, {_leaf_sql('other')} AS changed FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS k FROM h),
t AS (SELECT src, 0 AS lvl, pos, leaf AS node FROM l UNION ALL
  SELECT src, lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY src) AS c FROM t) WHERE c > 1 GROUP BY src, lvl, pos // 3),
s AS (SELECT *, row_number() OVER (ORDER BY src) - 1 AS place FROM (SELECT src, max(lvl) AS top, arg_max(node, lvl) AS subroot FROM t GROUP BY src)),
u AS (SELECT 0 AS lvl, place AS pos, subroot AS node FROM s UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS c FROM u) WHERE c > 1 GROUP BY lvl, pos // 3),
r AS (SELECT max(lvl) AS height, arg_max(node, lvl) AS root FROM u),
w AS (SELECT k, src, lvl AS step, lvl, pos // (3 ** lvl)::BIGINT AS pos, false AS upper FROM (SELECT k, src, pos, unnest(range(top)) AS lvl FROM l JOIN s USING (src))
  UNION ALL SELECT k, src, top + lvl, lvl, place // (3 ** lvl)::BIGINT, true FROM (SELECT k, src, top, place, unnest(range(height)) AS lvl FROM l JOIN s USING (src), r)),
x AS (SELECT src, lvl, pos, node, false AS upper FROM t UNION ALL SELECT NULL, lvl, pos, node, true FROM u),
p AS (SELECT w.k, w.step, coalesce(string_agg(node, '' ORDER BY x.pos) FILTER (x.pos < w.pos), '') AS before, coalesce(string_agg(node, '' ORDER BY x.pos) FILTER (x.pos > w.pos), '') AS after
  FROM w LEFT JOIN x ON x.upper = w.upper AND x.lvl = w.lvl AND x.pos // 3 = w.pos // 3 AND (w.upper OR x.src = w.src) GROUP BY w.k, w.step),
v AS (SELECT k, 0 AS step, changed AS node FROM l UNION ALL SELECT v.k, v.step + 1, sha256(concat(before, node, after)) FROM v JOIN p ON p.k = v.k AND p.step = v.step)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN s USING (src) JOIN (SELECT k, arg_max(node, step) AS folded_root FROM v GROUP BY k) USING (k)
 LEFT JOIN (SELECT k, string_agg(concat(before, after), '' ORDER BY step) AS proof FROM p GROUP BY k) USING (k), r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_vector_near_dups": _OP1, "op3_ngram_join": _OP3, "op4_license_scan": _license_sql(), "op7_suffix_dedup": _OP7,
        "op11_merkle_manifest": _OP11,
    }
