"""The toxicity model's labelled sample is the documented one."""

from conftest import frame

from storyloom.llm import toxicity


def test_sample_takes_forty_thousand(spark):
    docs = frame(spark, [(1, "some text", "s")]).select("text").crossJoin(spark.range(60_000).withColumnRenamed("id", "doc_id"))
    labels = spark.range(60_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    assert toxicity.marked(docs, labels, "toxic", toxicity.SAMPLE).count() == 40_000
    assert toxicity.SHARDS == 6
