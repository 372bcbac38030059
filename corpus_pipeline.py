"""A corpus pipeline over ``documents``: toxicity, line dedup, near-duplicates, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet to the shared folder and reads it
back as the next one's docs. All but the last return the columns of docs, extra ones included. Null, empty and repeated rows are
treated as the stage's operator says; an empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm import decontamination, linededup, mixing, neardup, toxicity
from storyloom.llm.tables import table
from storyloom.session import Workspace

#: Score from which a document is rejected.
REJECT = 0.5
#: Ids of at most so many dropped rows are broadcast; with more, Spark shuffles.
SMALL = 1_000_000


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, whatever the case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids.id; rows without an id stay."""
    held = F.broadcast(ids) if ids.count() <= SMALL else ids
    return docs.join(held.select(F.col("id").alias(gone := _free(docs, "id"))), docs["doc_id"] == F.col(gone), "left_anti")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic. The model learns from the labels of documents in docs, its held-out fold aside."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = _free(docs, "score")
    return toxicity.score(docs, model, tuple(docs.columns), name).where(F.col(name) < REJECT).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated and near-repeated lines; n_chars follows the text.

    Copies of a whole text are cut as the first of them is: they stay equal, so the next stage drops them.
    """
    names = _free(docs, "line_count"), _free(docs, "line_drops")
    out = linededup.dedup_lines(docs, names=names, copies=True)
    if "n_chars" in docs.columns:
        size = F.char_length(F.col("text").cast("string")).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(names[1]) > 0, size).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near-duplicates, five-word shingles, similarity of 0.8 or more.

    Of rows that share id and text the first by their other columns stays; rows of one id with other texts, with null
    texts, or without an id are no duplicates of each other.
    """
    room = Workspace(spark, "pipeline")
    found = neardup.near_duplicates(docs, k=5, percent=80)
    rest = _without(docs, room.save(found.where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct(), "dropped"))
    again = room.save(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).groupBy("doc_id").count().where("count > 1")
                      .select(F.col("doc_id").alias("id")), "again")
    if again.isEmpty():
        return rest
    place = _free(docs, "place")
    order = [F.asc_nulls_first(c) for c, kind in docs.dtypes if "map<" not in kind]
    several = rest.join(again, rest["doc_id"] == again["id"], "left_semi").withColumn(
        place, F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*order)))
    return _without(rest, again).unionByName(several.where(F.col("text").isNull() | (F.col(place) == 1)).drop(place))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which ten following words of a benchmark item, or a whole shorter item, occur."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document that the mix takes."""
    return mixing.mix(docs).where(F.col("copies") > 0)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL can't express the trained model or the draw; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    room = Workspace(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = room.save(stage(spark, docs, sf_dir), name)
    return docs
