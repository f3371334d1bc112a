from pyspark.sql import functions as F

from qbank.sources import tables


def test_many_records_share_files(spark, tmp_path):
    items = spark.range(900).select(
        (F.col("id") % 300).alias("paper_id"), (3 - F.col("id") % 900 / 300).cast("int").alias("n"), F.concat(F.lit('a "b", c\n'), "id").alias("question"), F.lit("").alias("correct_answer"),
        F.lit(" x").alias("user_answer"), F.lit("wrong").alias("status"), F.lit(0.5).alias("score"), F.lit("说").alias("comment"))
    tables.export_csv(items, str(tmp_path / "csv"), apart=False)
    files = list((tmp_path / "csv").rglob("*.csv"))
    assert len(files) <= 8 and all(f.read_text(encoding="utf-8-sig").startswith("题号,题目,标准答案,作答,状态,得分,点评,paper_id\n") for f in files)
    got = tables.read_exported(spark, str(tmp_path / "csv"), "paper_id long").select(*items.columns, F.col("_metadata.file_name").alias("file"))
    assert sorted(map(repr, got.drop("file").collect())) == sorted(map(repr, items.collect()))
    assert got.groupBy("paper_id").agg(F.count_distinct("file").alias("files")).where("files > 1").count() == 0
    order = [(r["paper_id"], r["n"]) for r in tables.read_exported(spark, str(files[0]), "paper_id long").coalesce(1).collect()]
    assert order == sorted(order)
