"""Input tables and small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged. Plain ASCII texts take the fast built-in."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle as the session has them; results never depend on this."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
