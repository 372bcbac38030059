import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, id long, node long, line_count string"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def frame(spark, rows):
    """documents with columns whose names operators might use themselves."""
    full = [(i, t, "en", s, None if t is None else len(t), 7, "x", 1, 2, "y") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def long_text(n=20000):
    return " ".join(f"w{(i * i) % 7919}x" for i in range(n))


def edge_rows():
    return [(0, None, "s1"), (1, "", "s1"), (2, " \n \t", None), (3, "Alpha beta", "s2"), (4, long_text(), "s1"), (5, long_text(), "s1"),
            (6, "alpha BETA", "s3"), (7, "one two three four five six seven eight nine ten eleven twelve", "s2"),
            (7, "one two three four five six seven eight nine ten eleven twelve", "s2"), (None, "one two three four five", "s2"),
            (9, None, None)]


@pytest.fixture
def edge(spark):
    return frame(spark, edge_rows()).repartition(2)


@pytest.fixture
def none(spark):
    return frame(spark, []).where(F.lit(True))
