from pyspark.sql import functions as F

from qbank.operators import imports


def test_texts_of_an_import_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        made.add(1)
        return text

    text = F.when(F.col("id") % 2 == 0, "1. 甲 = ____\n答案：乙").otherwise("第一节 甲\n乙\n1、丙\n丁")
    docs = spark.range(20).select(F.col("id").alias("doc_id"), counted(text).alias("text"))
    assert imports.read_documents(docs).count() == 30
    assert made.value <= 40
