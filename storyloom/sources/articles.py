"""Article files, the source catalogue and tables that grow by unseen rows."""

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.labels import canonical_category
from storyloom.functions.text import strip, text_or_empty
from storyloom.session import Workspace

ARTICLE_SCHEMA = T.StructType([
    T.StructField(n, T.StringType()) for n in (
        "scope", "category", "state", "district", "source", "title", "link", "summary", "author",
        "published_date", "published_at", "fetched_at")
])


_BROKEN = "_broken"


def read_articles(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Crawled article records, and the lines or files that are no records (file, text).

    A file whose first line that isn't blank starts with ``[`` is one JSON array, all others are JSON lines; a folder may
    hold both. Records come in the order of file names and of their places there, the first of each link is kept, and the
    category is canonical. Parsing is permissive: a broken line costs that line, a broken array its file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    first = lines.filter("trim(value) <> ''").withColumn("_row", F.monotonically_increasing_id()) \
        .groupBy("file").agg(F.min_by(F.ltrim("value"), F.struct("start", "_row")).alias("head"))
    # as many names as the listing of the folder already holds
    arrays = [r.file for r in first.filter(F.startswith("head", F.lit("["))).select("file").collect()]
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    schema = T.StructType([*ARTICLE_SCHEMA.fields, T.StructField(_BROKEN, T.StringType())])

    def read(multi: bool, files) -> DataFrame:
        reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN)
        return reader.option("multiLine", multi).json(files).select("*", *place)

    rows = read(False, path)
    if arrays:
        rows = rows.filter(~F.col("_file").isin(arrays)).unionByName(read(True, arrays))
    # saved, so that files are parsed once and row numbers stay as they are
    rows = Workspace(spark, "article-files").save(rows.withColumn("_row", F.monotonically_increasing_id()), "parsed")
    bad = rows.filter(F.col(_BROKEN).isNotNull()).select(F.col("_file").alias("file"), F.col(_BROKEN).alias("text"))
    good = rows.filter(F.col(_BROKEN).isNull()).drop(_BROKEN)
    return first_links(good, ("_file", "_start", "_row")).drop("_file", "_start", "_row"), bad


def first_links(df: DataFrame, order) -> DataFrame:
    """First record per non-empty link in the given order, with canonical category."""
    w = Window.partitionBy("link").orderBy(*order)
    return (
        df.filter(text_or_empty(F.col("link")) != "")
        .withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
        .withColumn("category", canonical_category(F.coalesce("category", F.lit("National"))))
    )


def known_links(df: DataFrame, link: str = "link") -> DataFrame:
    return df.select(link).filter(text_or_empty(F.col(link)) != "").distinct()


def append_unique(df: DataFrame, existing: DataFrame, link: str = "link") -> DataFrame:
    """Rows to append: one per link, of links the target does not hold."""
    return insert_new(df, existing, link)


def insert_new(df: DataFrame, existing: DataFrame, link: str = "link", order=()) -> DataFrame:
    """Only the genuinely new rows, the first of each link in the given order, or by all columns."""
    fresh = df.join(known_links(existing, link), link, "left_anti")
    w = Window.partitionBy(link).orderBy(*(order or [c for c, kind in sorted(fresh.dtypes) if "map<" not in kind]))
    return fresh.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def write_new(df: DataFrame, existing: DataFrame, path: str, link: str = "link", order=()) -> DataFrame:
    """Appends the rows that ``insert_new`` gives, and tells how many were offered, inserted and refused, in one pass.

    Rows are folded to the first of each link before the join, with their number; known links are flagged, not dropped, so
    that both counts are observed in the last stage, in which a task that runs again counts once.
    """
    columns = df.columns
    by = list(order) or [c for c, kind in sorted(df.dtypes) if "map<" not in kind]
    each = df.groupBy(link).agg(F.count(F.lit(1)).alias("_n"), F.min_by(F.struct(*columns), F.struct(*by)).alias("_row"))
    known = known_links(existing, link).select(F.col(link).alias("_known"))
    seen, new = Observation("inserts"), F.col("_known").isNull() & F.col(link).isNotNull()
    flagged = each.join(known, each[link] == known["_known"], "left").observe(
        seen, F.sum("_n").alias("offered"), F.count_if(new).alias("inserted"))
    flagged.filter(new).select("_row.*").write.mode("append").parquet(path)
    offered, inserted = seen.get.get("offered") or 0, seen.get.get("inserted") or 0
    return df.sparkSession.createDataFrame([(offered, inserted, offered - inserted)], "offered long, inserted long, duplicates long")


def read_sources(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Source catalogue with defaults, one row per name (the last in file order of id)."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return catalogue(reader.format(fmt).load(path))


def catalogue(raw: DataFrame) -> DataFrame:
    """Catalogue rows with defaults; names are unique, tiers are text."""
    wanted = {
        "name": None, "category": "national", "region": None, "district": None, "rss_url": None,
        "trust_tier": "2", "source_type": "rss", "verified_local_source": "false", "is_active": "true",
    }
    cols = []
    for name, default in wanted.items():
        c = F.col(name).cast("string") if name in raw.columns else F.lit(None).cast("string")
        cols.append((c if default is None else F.coalesce(c, F.lit(default))).alias(name))
    rows = raw.select(*cols).withColumn("name", strip(text_or_empty(F.col("name")))).filter("name <> ''")
    rest = [n for n in wanted if n != "name"]
    one = rows.groupBy("name").agg(F.max(F.struct(*rest)).alias("_r")).select("name", "_r.*")
    return (
        one.withColumn("source_id", F.sha2("name", 256))
        .withColumn("is_active", F.col("is_active").cast("boolean"))
        .withColumn("verified_local_source", F.col("verified_local_source").cast("boolean"))
    )
