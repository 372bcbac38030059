"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.session import Workspace

from .textblocks import SPACES, blocks, per_row, words

#: Documents of one leaf of the reduction tree, and children of each node above.
LEAF, FAN_IN = 2048, 64

_MASK = (1 << 64) - 1
_STATE = "source_key string, node long, doc_id long, size long, whole long, mass double, open boolean"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words) of every document; a null text has size 0."""

    def count(batches):
        for block in blocks(batches):
            starts, _ = words(block.raw, SPACES)
            yield pa.RecordBatch.from_arrays(
                [block.rows.column("doc_id"), block.rows.column("source"), pa.array(per_row(starts, block.offsets))],
                names=["doc_id", "source", "size"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")) \
        .mapInArrow(count, "doc_id long, source string, size long")


def targets(sized: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """source, docs, source_size and target of every source.

    Sources in code-point order, null last, take the weights in turn and share the size of all documents. A target stops at
    ``cap`` times its source's size; the excess goes to the others by weight. With sources in the order in which they
    reach their cap, two running sums give the level of the rest if all before are at their cap; the highest holds.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    each = sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    each = each.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) \
        / F.sum("weight").over(onward)
    each = each.withColumn("level", level)
    each = each.withColumn("level", F.max("level").over(everything))
    return each.select("source", "docs", "source_size",
                       F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def _uniform(seed: int, *keys: int) -> float:
    """A number in [0, 1) that depends on the keys alone."""
    x = seed
    for k in keys:
        x = ((x ^ (k & _MASK)) * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & _MASK
        x ^= x >> 29
        x = (x * 0xBF58476D1CE4E5B9) & _MASK
        x ^= x >> 32
    return (x >> 11) / (1 << 53)


def _settle(seed: int, last: bool):
    """Settles the open documents of a node but one, pair by pair."""

    def node(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "size"], kind="stable").reset_index(drop=True)
        size, mass, ids = frame["size"].tolist(), frame["mass"].tolist(), frame["doc_id"].fillna(-1).astype("int64").tolist()
        undecided = [False] * len(size)
        held = -1
        for i, s in enumerate(size):
            if not 0 < mass[i] < s:
                continue
            if held < 0:
                held = i
                continue
            up = min(size[held] - mass[held], mass[i])
            down = min(mass[held], s - mass[i])
            if _uniform(seed, ids[held], ids[i], i) * (up + down) < down:
                filled = size[held] - mass[held] <= mass[i]
                mass[held], mass[i] = (size[held], mass[i] - up) if filled else (mass[held] + up, 0)
            else:
                emptied = mass[held] <= s - mass[i]
                mass[held], mass[i] = (0, mass[i] + down) if emptied else (mass[held] - down, s)
            if not 0 < mass[held] < size[held]:
                held = i if 0 < mass[i] < s else -1
        if held >= 0 and last:
            mass[held] = size[held] if _uniform(seed, ids[held], 7) * size[held] < mass[held] else 0
        elif held >= 0:
            undecided[held] = True
        return frame.assign(mass=mass, open=undecided)[
            ["source_key", "node", "doc_id", "size", "whole", "mass", "open"]]

    return node


def mix(docs: DataFrame, weights=(1, 2, 3), cap: int = 3, seed: int = 20240607) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    Every document of a source starts with target / source_size copies. The whole part is settled; of the fractions, pairs
    exchange word mass at random, each keeping its expectation and the pair its sum, until one of them is 0 or 1. Leaves of
    some 2,048 documents, picked by a hash of the id, settle all but one document each; the rest meet at nodes of 64
    children, level by level, until each source has at most one open document, which is drawn by its fraction. So a
    source's words differ from its target by less than one document. Nodes follow from the number of documents alone:
    reruns and other partitions give the same mix. No node sees more than its leaf or children, however large a source is.

    A null or wordless text has size 0 and takes nothing; it counts as one copy less than cap, never as a fraction. A null
    source is a source of its own, the last. Rows with one id are settled apart. An empty table gives an empty result.
    Other columns of docs are not read.
    """
    spark = docs.sparkSession
    room = Workspace(spark, "mixing")
    sized = room.save(sizes(docs), "sizes")
    plan = room.save(targets(sized, weights, cap), "targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = sized.join(F.broadcast(plan) if plan.count() <= 10_000 else plan, sized["source"].eqNullSafe(plan["source"])) \
        .select(F.concat(F.when(sized["source"].isNull(), "0").otherwise("1"), F.coalesce(sized["source"], F.lit("")))
                .alias("source_key"), "doc_id", "size", share.alias("share"), "docs")
    leaves = F.greatest(F.ceil(F.col("docs") / LEAF), F.lit(1))
    state = state.select(
        "source_key", F.pmod(F.xxhash64("doc_id"), leaves).alias("node"), "doc_id",
        "size",
        F.floor("share").alias("whole"), ((F.col("share") - F.floor("share")) * F.col("size")).alias("mass"))
    most = plan.agg(F.max("docs")).collect()[0][0] or 0
    nodes, settled = -(-most // LEAF), []
    while True:
        last = nodes <= 1
        level = room.save(state.groupBy("source_key", "node").applyInPandas(_settle(seed + len(settled), last), _STATE), "level")
        settled.append(level.where(~F.col("open")))
        if last:
            break
        state = level.where("open").withColumn("node", F.floor(F.col("node") / FAN_IN)).drop("open")
        nodes = -(-nodes // FAN_IN)
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    copies = F.col("whole") + F.when((F.col("mass") > 0) & (F.col("mass") >= F.col("size")), 1).otherwise(0)
    rows = rows.select(F.when(F.col("source_key").startswith("1"), F.expr("substring(source_key, 2)")).alias("source"),
                       "doc_id", "size", copies.alias("copies"))
    near = plan.withColumnRenamed("source", "name")
    return rows.join(F.broadcast(near) if near.count() <= 10_000 else near, rows["source"].eqNullSafe(near["name"])).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
