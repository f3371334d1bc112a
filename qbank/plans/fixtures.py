"""Views over the supplied tables in SQL that Spark and DuckDB read alike: a bank, submissions, layout marks and texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from qbank.plans import papers

TABLES = ("documents", "labels", "pages", "events", "embeddings", "conversations", "benchmark")


def _w(k: int) -> str:
    return f"concat('w', cast(doc_id * {k} % 97 as string))"


VIEWS = {
    "bank": """select d.doc_id + 1 as id, d.source as subject, d.lang as course,
 case d.doc_id % 8 when 0 then 'single' when 1 then 'multi' when 2 then 'blank' when 3 then 'judge'
   when 4 then 'essay' when 5 then 'calc' when 6 then 'thinking' else ' Single_Choice ' end as qtype_raw,
 split_part(d.text, chr(10), 1) as question,
 case d.doc_id % 8 when 0 then chr(cast(65 + d.doc_id % 4 as int)) when 7 then chr(cast(97 + d.doc_id % 4 as int))
   when 1 then case when d.doc_id % 3 = 0 then 'A,C' else 'bd' end
   when 2 then concat(split_part(d.text, ' ', 2), '，', split_part(d.text, ' ', 3))
   when 3 then case when d.doc_id % 16 < 8 then '正确' else 'F' end
   when 5 then concat(cast(d.doc_id % 7 + 1 as string), '/', cast(d.doc_id % 5 + 2 as string))
   when 4 then '' else '（待补充答案）' end as answer,
 concat('file', cast(d.doc_id % 37 as string), '.txt') as source_file,
 coalesce(l.quality = 0, false) as pending_review
from documents d left join labels l on l.doc_id = d.doc_id""",
    "submissions": """select e.event_id, e.user_id as paper_id, e.event_id % (select count(*) from documents) + 1 as question_id,
 case e.event_id % 6 when 0 then 'A' when 1 then 'c, a' when 2 then '对' when 3 then '×'
   when 4 then cast(round(e.value, 2) as string) else '' end as user_answer from events e""",
    "marks": """select user_id as doc, cast(extract(day from ts) as int) as page,
 cast(extract(hour from ts) * 60 + extract(minute from ts) as double) as y,
 case when event_type = 'signup' then 0 else 1 end as kind,
 case when event_type = 'signup' then cast(event_id % 20 + 1 as string) end as key,
 case when event_type = 'view' then concat('img', cast(event_id % 200 as string), '.png') end as fname, event_id
from events where event_type in ('signup', 'view')""",
    "boxes": """select user_id as doc, event_id, cast(value as double) as x0,
 cast(extract(hour from ts) * 60 + extract(minute from ts) as double) as y0,
 cast(value as double) + cast(event_id % 60 as double) as x1,
 cast(extract(hour from ts) * 60 + extract(minute from ts) as double) + cast(event_id % 40 as double) as y1 from events""",
    "anchored": """select id, case when id % 5 = 0 then concat(question, ' 【图:img', cast(id % 200 as string), '.png】') else question end as question,
 case when id % 7 = 0 then concat('img', cast(id % 210 as string), '.png') end as image from bank""",
    "files": "select distinct concat('img', cast(doc_id % 150 as string), '.png') as name from documents where doc_id % 150 <> 5",
    # Bars, as concat of a null text is null in Spark alone.
    "noisy": """select doc_id, case doc_id % 5 when 0 then '第 1 页 / 共 2 页' || chr(10) || '-----' || chr(10) || text
 when 1 then replace(text, ' t', ' ') when 2 then replace(text, ' ', ' x ')
 when 3 then '下列说法正确的是' || chr(10) || '电磁波是横波' || chr(10) || text else text end as text from documents""",
    "exam": f"""select doc_id, concat('一、单选题', chr(10), '1. ', {_w(3)}, ' ', {_w(5)}, ' 正确的是（ ）', chr(10), 'A. ', {_w(7)}, chr(10), 'B. ', {_w(11)}, chr(10), '答案：B', chr(10),
 '二、填空题', chr(10), '2. ', {_w(13)}, ' = ____', chr(10), '答案：', {_w(7)}, chr(10), '三、判断题', chr(10), '3. ', {_w(17)}, ' ', {_w(19)}, chr(10), '答案：正确') as text from documents""",
    "latexed": """select doc_id, case doc_id % 3 when 0 then replace(text, ' t', concat(' ', chr(92), 'zq t'))
 when 1 then replace(text, ' t', concat(' ', chr(92), 'alpha t')) else text end as text from documents""",
    "replies": """select event_id, concat(chr(10), ' ', case event_id % 6 when 0 then '不正确' when 1 then '正确' when 2 then '不完全对' when 3 then '回答错误'
 when 4 then '对，但不全' else coalesce(props, '') end) as reply from events""",
    "incoming": """select id as seq, subject, course, qtype_raw, case when id % 3 = 0 then concat(question, '；') when id % 3 = 1 then question
 else concat(question, ' #', cast(id as string)) end as question, answer, 'batch2.txt' as source_file, id % 11 = 0 as pending_review
from bank where id % 2 = 0""",
    # A bank of full width, and a batch that brings each of its questions five times: with other punctuation, anchors, options,
    # answers and explanations, and as a new question. Options are joined by bars.
    "held": """select id, subject, course, case when id % 9 = 0 then 'unit 1' else '' end as topic, qtype_raw,
 case when id % 6 = 0 then concat(question, ' 【图:img', cast(id % 20 as string), '.png】') else question end as question,
 case when id % 3 = 0 then '' else concat(split_part(question, ' ', 2), '|', split_part(question, ' ', 3)) end as options, answer,
 concat('why ', cast(id as string)) as explanation, source_file, pending_review from bank""",
    "arriving": """select cast(k as bigint) * 1000000000 + id as seq, subject, course, concat('wave ', cast(k as string)) as topic, qtype_raw,
 case when k = 4 then concat(question, ' #', cast(id as string)) when (id + k) % 4 = 0 then concat(question, ' 【图:scan', cast((id + k) % 9 as string), '.png】')
   when (id + k) % 4 = 1 then concat(question, '；') else question end as question,
 case when id % 3 = 0 then '' else concat(split_part(question, ' ', 2), case when k = 2 then '。|' else '|' end, split_part(question, ' ', 3)) end as options,
 case when (id * 3 + k) % 7 = 0 then concat(answer, '。') else answer end as answer, concat('wave ', cast(k as string), ' why ', cast(id as string)) as explanation,
 concat('batch', cast(k % 3 as string), '.txt') as source_file, (id * 5 + k) % 13 = 0 as pending_review
from bank cross join (values (0), (1), (2), (3), (4)) as waves(k)""",
}


VIEWS |= papers.VIEWS


def _named(sql: str) -> set[str]:
    """The views that sql names, and those that these name."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        new = {v for v in VIEWS if re.search(rf"\b{v}\b", text)} - found
        found |= new
        todo += [VIEWS[v] for v in new]
    return found


def with_views(sql: str) -> str:
    """sql after the views that it needs."""
    names = _named(sql)
    held = ",\n".join(f"{name} AS ({body})" for name, body in VIEWS.items() if name in names)
    if not held:
        return sql
    return f"WITH {held}\n{sql}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views, or a supplied table, over the tables in sf_dir."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for t in TABLES[:4]:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(with_views(f"SELECT * FROM {name}"))
