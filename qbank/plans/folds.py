"""SQL that takes a bank and a batch one row after the other, for comparison with the upsert."""

from __future__ import annotations


def fold_sql(held: str, arriving: str) -> str:
    """Tables r (all rows) and m (one row for each fingerprint: id, new, first, b with the first row's columns, s with the state at
    the end, files) of two relations with the columns of a bank, options joined by bars."""
    text = "content_hash, {0} AS part, {1} AS seq, {2} AS id, question, answer, options, explanation, source_file, pending_review, subject, course, topic, qtype"
    return f"""r AS (SELECT {text.format(0, 'id', 'id')} FROM {held} UNION ALL SELECT {text.format(1, 'seq', 'NULL')} FROM {arriving}),
l AS (SELECT content_hash, list({{'q': question, 'a': answer, 'o': options, 'x': explanation, 'p': pending_review}} ORDER BY part, seq) AS l, min(id) AS id, min(seq) FILTER (part = 1) AS first,
 arg_min({{'s': subject, 'c': course, 't': topic, 'k': qtype}}, [part, seq]) AS b FROM r GROUP BY content_hash),
s AS (SELECT content_hash, id, first, b, list_reduce(l, lambda s, r: CASE WHEN (r.q <> s.q AND NOT (contains(s.q, '【图:') AND NOT contains(r.q, '【图:'))) OR r.a <> s.a THEN r
 ELSE struct_pack(q := s.q, a := s.a, o := s.o, x := s.x, p := s.p OR r.p) END) AS s FROM l),
n AS (SELECT content_hash, (SELECT max(id) FROM bank) + row_number() OVER (ORDER BY first) AS id FROM s WHERE id IS NULL),
f AS (SELECT content_hash, string_agg(source_file, ',' ORDER BY place) AS files FROM (SELECT content_hash, source_file, min([part, seq]) AS place FROM r GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT content_hash, coalesce(s.id, n.id) AS id, s.id IS NULL AS new, first, b, s, files FROM s LEFT JOIN n USING (content_hash) JOIN f USING (content_hash))"""
