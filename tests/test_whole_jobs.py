"""Queries give the whole of what they are asked for, in plans that fit."""

from pyspark.sql import functions as F

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_stream_topics_gives_all_windows_and_topics(spark):
    got = entry.queries()["stream_topics"](spark, FOLDER)
    words = spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w"))
    from storyloom import constants as K

    words = words.filter(F.col("w").rlike("^[A-Z][a-zA-Z0-9]{2,}$") & ~F.lower("w").isin(K.TREND_STOPWORDS))
    # each mention counts in 24 windows
    assert got.agg(F.sum("mentions")).collect()[0][0] == 24 * words.count()
    assert got.select("topic").distinct().count() == words.distinct().count()
    assert got.groupBy("until").count().agg(F.max("count")).collect()[0][0] > 8
