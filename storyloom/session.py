"""Session settings and the shared folder for cut lineage."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def pin_session(spark: SparkSession) -> SparkSession:
    """Pin the settings that change results, whoever built the session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cpus: str = "8", app: str = "storyloom", memory: str = "16g") -> SparkSession:
    """A single-machine session for tests and the bench, with a shared folder of its own where the defaults name none."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.stop()
        spark = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="storyloom-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return pin_session(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, named by ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir, when the session is built, to a folder that all executors can reach")
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """Path below the shared folder that nothing uses yet."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


class Workspace:
    """Writes intermediate tables to the shared folder and reads them back.

    Reading back cuts the lineage, survives lost executors, and gives Catalyst
    true sizes, so that a broadcast is chosen by measured size only.
    """

    def __init__(self, spark: SparkSession, label: str, codec: str = "snappy"):
        self.spark, self.codec = spark, codec
        self.root = new_folder(spark, label)
        self.count = 0
        self.saved: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame, label: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{label}"
        df.write.mode("overwrite").option("compression", self.codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.saved.append((out, path))
        return out

    def drop(self, table: DataFrame) -> None:
        """Deletes a saved table that nothing reads any more."""
        self.keep(*[x for x, _ in self.saved if x is not table])

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all tables saved so far but these, which what is returned still reads."""
        jvm, left = self.spark._jvm, []
        for table, path in self.saved:
            if any(table is x for x in tables):
                left.append((table, path))
            else:
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self.saved = left
