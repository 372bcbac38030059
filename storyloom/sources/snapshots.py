"""Versions of a result table: readers see the last whole one, whatever happens to a write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: File in a table's folder that names its current version.
POINTER = "CURRENT"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Names the version in a file of its own, then renames that over the pointer in one step."""
    jvm, staged, fs = _hadoop(spark, f"{path}/.{version}.pointer")
    out = fs.create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(staged), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")), how)


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder name of the version that readers get; None before the first."""
    _, place, fs = _hadoop(spark, f"{path}/{POINTER}")
    return spark.read.text(f"{path}/{POINTER}").first()[0] if fs.exists(place) else None


def write_version(df: DataFrame, path: str, by=(), keep: int = 2) -> str:
    """Writes df as a new version and makes it the current one; the last ``keep`` versions stay, for readers that are under way.

    The pointer changes after all files are there. If a task, the driver or the rename fails, it still names the version
    before, and the half-written folder goes with the next write.
    """
    spark = df.sparkSession
    before = current_version(spark, path)
    number = int(before.split("-")[1]) + 1 if before else 1
    version = f"version-{number:09d}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/{version}")
    _point(spark, path, version)
    _, place, fs = _hadoop(spark, path)
    for status in fs.listStatus(place):
        name = status.getPath().getName()
        if name.startswith("version-") and name != version and name != before:
            if int(name.split("-")[1]) <= number - keep or name.split("-")[1] == f"{number:09d}":
                fs.delete(status.getPath(), True)
    return version


def read_version(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The current version."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path} has no version")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{path}/{version}")
