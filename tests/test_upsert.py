"""The fold by fingerprint against taking rows one after the other, in few and in many stretches."""

import random

import pytest
from pyspark.sql import functions as F

from qbank.operators import bank as B
from qbank.operators import ranks, upsert

COLUMNS = "content_hash string, question string, answer string, options array<string>, explanation string, source_file string, pending_review boolean, images array<string>, topic string"


def one_by_one(rows):
    """rows of one fingerprint in order -> its state."""
    state = None
    for r in rows:
        if state is None:
            state = {**r, "files": [r["source_file"]], "images": list(dict.fromkeys(r["images"]))}
            continue
        lost = "【图:" in state["question"] and "【图:" not in r["question"]
        changed = (state["question"] != r["question"] and not lost) or state["answer"] != r["answer"]
        if changed:
            state |= {c: r[c] for c in ("question", "answer", "options", "explanation", "pending_review")}
        state["pending_review"] = state["pending_review"] or r["pending_review"]
        state["files"] += [f for f in [r["source_file"]] if f not in state["files"]]
        state["images"] += [i for i in r["images"] if i not in state["images"]]
    return state


@pytest.mark.parametrize("parts", ["1", "4", "60"])
def test_fold(spark, parts):
    rng = random.Random(int(parts))
    make = lambda i: (
        f"h{min(int(rng.expovariate(0.2)), 25)}", rng.choice(["q", "q；", "q 【图:a】", "q 【图:b】"]), rng.choice(["1", "1", "1", "1", "1。"]), [f"o{i}"], f"x{i}",
        f"f{rng.randrange(5)}", rng.random() < 0.1, [f"i{rng.randrange(4)}"], f"t{i}",
    )
    own, new = [(i, *make(i)) for i in range(1, 250)], [(i, *make(i)) for i in range(1, 900)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        after, done = upsert.upsert_batch(spark.createDataFrame(own, f"id long, {COLUMNS}").repartition(3), spark.createDataFrame(new, f"seq long, {COLUMNS}").repartition(5))
        got, outcomes = {r["content_hash"]: r.asDict() for r in after.collect()}, {r["seq"]: (r["id"], r["outcome"]) for r in done.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    groups, ids, want_done, top = {}, {}, {}, 249
    for r in own:
        groups.setdefault(r[1], []).append(dict(zip(names, r[1:], strict=True)))
        ids.setdefault(r[1], r[0])
    for r in new:
        fresh = r[1] not in ids
        if fresh:
            top += 1
            ids[r[1]] = top
        want_done[r[0]] = (ids[r[1]], "inserted" if fresh else "merged")
        groups.setdefault(r[1], []).append(dict(zip(names, r[1:], strict=True)))
    assert outcomes == want_done
    for h, rows in groups.items():
        want = one_by_one(rows)
        want.pop("source_file")
        assert got[h] == {**want, "id": ids[h]}, h
    assert len(got) == len(groups)


def test_upsert_into_its_own_result(spark):
    columns = "content_hash string, question string, answer string, source_file string, pending_review boolean"
    batch = spark.createDataFrame([(1, "h", "q", "a", "one", False), (2, "h", "q.", "a", None, True), (3, "k", None, None, "", None)], f"seq long, {columns}")
    empty = spark.createDataFrame([], f"id long, {columns}")
    first, done = upsert.upsert_batch(empty, batch)
    assert {(r["seq"], r["id"], r["outcome"]) for r in done.collect()} == {(1, 1, "inserted"), (2, 1, "merged"), (3, 2, "inserted")}
    again, done = upsert.upsert_batch(first, batch)
    assert {(r["id"], r["outcome"]) for r in done.collect()} == {(1, "merged"), (2, "merged")}
    rows = {r["id"]: (r["question"], r["files"], r["pending_review"]) for r in again.collect()}
    assert rows == {1: ("q.", ["one"], True), 2: ("", [], False)}


def test_numbers_whatever_the_order(spark):
    far = [1, 2, 3, 5, 8, 10**15, 10**15 + 1]
    rows = spark.createDataFrame([(x,) for x in reversed(far)], "seq long")
    assert [(r["seq"], r["n"]) for r in ranks.numbered(rows, "seq").orderBy("seq").collect()] == [(x, i + 1) for i, x in enumerate(far)]
    bank = spark.createDataFrame([(7, "a")], "id long, question string")
    got = B.insert(bank, rows.withColumn("question", rows["seq"].cast("string"))).orderBy("id").collect()
    assert [r["id"] for r in got] == [7, *range(8, 15)] and got[-1]["question"] == str(10**15 + 1)
    assert ranks.numbered(rows.limit(0), "seq").count() == 0


def test_sides_that_are_dealt_by_fingerprint_already(spark):
    """As a union of them is not, whatever it claims."""
    columns = "content_hash string, question string, answer string, source_file string, pending_review boolean"
    rows = [(i, f"h{i % 50}", f"q{i % 50}", "a", f"f{i % 3}", False) for i in range(1, 3000)]
    dealt = lambda df, key: df.repartition("content_hash").groupBy("content_hash").agg(*[F.first(c).alias(c) for c in ("question", "answer", "source_file", "pending_review")], F.min(key).alias(key))
    own, new = dealt(spark.createDataFrame(rows[:40], f"id long, {columns}"), "id"), dealt(spark.createDataFrame(rows, f"seq long, {columns}"), "seq")
    assert upsert.upsert(own, new).count() == 50
    assert upsert.upsert(own, new).groupBy("content_hash").count().where("count > 1").count() == 0


def test_rows_of_a_batch_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        made.add(1)
        return text

    rows = lambda name: spark.range(40).select(F.col("id").alias(name), F.concat(F.lit("q"), F.col("id") % 30).alias("question"), F.lit("a").alias("answer"), F.lit("f").alias("source_file"), F.lit(False).alias("pending_review"))
    bank, batch = (r.withColumn("content_hash", F.md5("question")) for r in (rows("id").where("id < 20"), rows("seq").withColumn("question", counted("question"))))
    after, done = upsert.upsert_batch(bank, batch)
    assert (after.count(), done.count(), done.where("outcome = 'inserted'").count()) == (30, 40, 10)
    assert made.value <= 80  # a row's text and its fingerprint, each once
