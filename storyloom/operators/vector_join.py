"""Exact threshold join of vectors by cosine.

Vectors with equal components are one class.  Unit vectors are dealt into cells by the nearest of a few pivots and, in each
cell, by their angle to it, into blocks of a fixed size, each one row.  Angles obey the triangle inequality, so two blocks whose
angles to some pivot lie further apart than the threshold allows never meet.  Blocks travel in shelves, so that a vector is sent
once to each shelf that it meets and not to each block.  Blocks that meet are multiplied in single precision, whose error has a
bound; pairs that may reach the threshold are computed again in double.  What leaves a block pair are matches and a count,
never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators.ranks import positions
from storyloom.session import Workspace

PIVOTS, BLOCK = 32, 1024
#: Blocks of a shelf at most; matches that a task holds before it passes them on.
SHELF, HELD = 32, 1 << 20

_PLACED = "id long, unit array<double>, cell int, own double, angles array<double>"
_BLOCKS = "block long, ids binary, units binary, cells array<struct<cell: int, low: array<double>, high: array<double>>>"
_FOUND = "a_block long, b_block long, formed long, hits array<struct<a: long, b: long, similarity: double>>"


def vector_classes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, class_id (the smallest id with the same components) and vector of every usable row.

    Null vectors, null or non-finite components and vectors of length zero have no cosine and take no part; a null id neither.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists("vector", lambda x: x != 0))
    classes = rows.groupBy("vector").agg(F.min("id").alias("class_id"))
    return rows.join(classes, "vector").select("id", "class_id", "vector")


def _pivots(units: DataFrame) -> np.ndarray:
    """A fixed number of vectors, drawn by a hash of their id; any choice gives the same result."""
    drawn = units.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    return np.array([r.unit for r in drawn])


def _place(pivots: np.ndarray):
    def run(frames):
        for frame in frames:
            x = np.array(frame["unit"].tolist())
            angles = np.arccos(np.clip(x @ pivots.T, -1, 1)) if len(x) else np.zeros((0, len(pivots)))
            cell = angles.argmin(1) if len(x) else np.zeros(0, int)
            yield pd.DataFrame({"id": frame["id"], "unit": frame["unit"], "cell": cell, "own": angles[np.arange(len(x)), cell],
                                "angles": list(angles)})

    return run


def _packed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """One row for a block: its ids and vectors as bytes, and the least and greatest angles of its rows in each cell."""
    def matrix(name):
        return rows.column(name).combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)

    cell, angles = rows.column("cell").to_numpy(), matrix("angles")
    cells = [{"cell": int(c), "low": angles[cell == c].min(0).tolist(), "high": angles[cell == c].max(0).tolist()} for c in np.unique(cell)]
    return pa.table({"block": [key[0].as_py()], "ids": [rows.column("id").to_numpy().astype("<i8").tobytes()],
                     "units": [matrix("unit").astype("<f8").tobytes()], "cells": [cells]},
                    schema=pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("units", pa.binary()), ("cells", pa.list_(pa.struct(
                        [("cell", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])))]))


def _multiply(threshold: float, dims: int):
    # bound of the error of a product of unit vectors in single precision
    slack = (dims + 8) * 2.0 ** -23

    def matches(x, y, fast_x, fast_y, ia, ib, same):
        at = np.flatnonzero((fast_x @ fast_y.T).ravel() >= np.float32(threshold - slack))
        i, j = at // len(ib), at % len(ib)
        if same:
            i, j = i[ia[i] < ib[j]], j[ia[i] < ib[j]]
        sims = np.round(np.einsum("ij,ij->i", x[i], y[j]), 12)
        hit = sims >= threshold
        a, b = ia[i[hit]], ib[j[hit]]
        return len(i), np.minimum(a, b), np.maximum(a, b), sims[hit]

    def batch(found):
        sizes = [len(f[3]) for f in found]
        hits = pa.StructArray.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (3, 4, 5)], names=["a", "b", "similarity"])
        return pa.RecordBatch.from_arrays(
            [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1, 2)]
            + [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), hits)], names=["a_block", "b_block", "formed", "hits"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], {}
        for frame in frames:
            for block, wanted, ids, units in zip(*(frame.column(c) for c in ("block", "wanted", "ids", "units"))):
                x = np.frombuffer(units.as_buffer(), "<f8").reshape(-1, dims)
                held = np.frombuffer(ids.as_buffer(), "<i8"), x, x.astype(np.float32)
                if wanted.is_valid:
                    left.append((block.as_py(), wanted.as_py(), *held))
                else:
                    right[block.as_py()] = held
        found, size = [], 0
        for a, wanted, ia, x, fast_x in left:
            for b in wanted:
                ib, y, fast_y = right[b]
                found.append((a, b, *matches(x, y, fast_x, fast_y, ia, ib, a == b)))
                size += len(found[-1][3])
                if size >= HELD:
                    yield batch(found)
                    found, size = [], 0
        if found:
            yield batch(found)

    return run


def _sides(blocks: DataFrame, pairs: DataFrame, span: int) -> DataFrame:
    """The blocks of every two shelves that meet: of the first shelf with the blocks that each is wanted with, of the second without."""
    rows = blocks.select("block", "ids", "units")
    shelf = {x: F.floor(F.col(f"{x}_block") / span).alias(f"{x}_shelf") for x in "ab"}
    one = pairs.groupBy(F.col("a_block").alias("block"), shelf["a"], shelf["b"]).agg(F.collect_list("b_block").alias("wanted"))
    two = pairs.select(F.col("b_block").alias("block"), shelf["a"], shelf["b"], F.lit(None).cast("array<long>").alias("wanted")).distinct()
    return one.unionByName(two).join(rows, "block")


def similar_blocks(classes: DataFrame, threshold: float) -> DataFrame:
    """a_block, b_block, formed (pairs computed whole) and hits of every two blocks that may hold a match."""
    work = Workspace(classes.sparkSession, "vectors")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    units = work.save(classes.filter("id = class_id").select("id", F.transform("vector", lambda x: x / length).alias("unit")), "units")
    pivots = _pivots(units)
    if not len(pivots):
        return classes.sparkSession.createDataFrame([], _FOUND)
    dims = pivots.shape[1]
    placed = positions(units.mapInPandas(_place(pivots), _PLACED), ["cell", "own", "id"], "place")
    placed = placed.withColumn("block", F.floor((F.col("place") - 1) / BLOCK))
    blocks = work.save(placed.groupBy("block").applyInArrow(_packed, _BLOCKS), "blocks")
    cells = work.save(blocks.select("block", F.inline("cells")), "cells")
    # cells that can meet: their angles to each pivot, compared once for the fixed number of cells
    wide = cells.groupBy("cell").agg(
        F.array(*[F.min(F.get("low", F.lit(i))) for i in range(len(pivots))]).alias("low"),
        F.array(*[F.max(F.get("high", F.lit(i))) for i in range(len(pivots))]).alias("high")).collect()
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-7
    meet = [(p.cell, q.cell) for p in wide for q in wide
            if all(max(pl - qh, ql - ph) <= reach for pl, ph, ql, qh in zip(p.low, p.high, q.low, q.high))]
    meet = classes.sparkSession.createDataFrame(meet, "a_cell int, b_cell int")
    one, two = (cells.select(*[F.col(c).alias(f"{x}_{c}") for c in ("block", "cell", "low", "high")]) for x in "ab")
    gap = F.array_max(F.zip_with(F.zip_with("a_low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "a_high", lambda x, y: x - y), lambda x, y: F.greatest(x, y)))
    pairs = one.join(meet, "a_cell").join(two, "b_cell").filter((F.col("a_block") <= F.col("b_block")) & (gap <= reach))
    pairs = work.save(pairs.select("a_block", "b_block").distinct(), "pairs")
    # few blocks lie in smaller shelves, so that all cores have shelves to multiply
    fewest = int(np.ceil(np.sqrt(8 * classes.sparkSession.sparkContext.defaultParallelism)))
    span = max(1, min(SHELF, blocks.count() // fewest))
    work.keep(blocks, pairs)
    return _sides(blocks, pairs, span).groupBy("a_shelf", "b_shelf").applyInArrow(_multiply(threshold, dims), _FOUND)


def similar_vectors(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """a, b, similarity of all classes a < b whose cosine, rounded to 12 places, reaches the threshold.

    Vectors are named by their class, the smallest id with the same components; ``vector_classes`` tells the members. All
    vectors have one number of components. An empty table gives an empty result.
    """
    work = Workspace(vectors.sparkSession, "vectors")
    found = similar_blocks(work.save(vector_classes(vectors, key, vector), "classes"), threshold)
    work.keep()
    return found.select(F.explode("hits").alias("h")).select("h.a", "h.b", "h.similarity")
