"""Exact top-k inner-product search by distributed histogram selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.session import Workspace

#: Vectors of a block of candidates and of queries; bins of a histogram.
ROWS, QUERIES, BINS = 4096, 512, 256

_LOWEST, _HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_BLOCK = "block int, ids binary, vectors binary"
_STATE = "qb int, qids binary, qvectors binary, state binary"
#: What is known of each query: phase 0 looks for the kth score, 1 for the largest id among its ties, 2 is done.
_KNOWN = np.dtype([("phase", "i8"), ("lo", "i8"), ("hi", "i8"), ("width", "i8"), ("need", "i8"), ("value", "i8"), ("limit", "i8")])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: an id, and a vector of finite components."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")) \
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(whole, F.lit(False)))


def _blocks(vectors: DataFrame, count: int, rows: int, width: int, scale: float, kind: str) -> DataFrame:
    """Rows dealt by a hash of the id into blocks of some ``rows`` vectors, scaled and floored, short ones filled with 0."""

    def pack(part: pa.Table) -> pa.Table:
        lists = part.column("embedding").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        out = np.zeros((len(part), width), kind)
        at = np.repeat(np.arange(len(part)), lengths)
        place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[at, place] = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
        return pa.table({"block": pa.array([part.column("block")[0].as_py()], pa.int32()),
                         "ids": pa.array([part.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                         "vectors": pa.array([out.tobytes()], pa.binary())})

    number = max(1, -(-count // rows))
    return vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(number)).cast("int")) \
        .groupBy("block").applyInArrow(pack, _BLOCK)


def _scores(row: dict, width: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, qids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["qids"], np.int64)
    c = np.frombuffer(row["vectors"], kind).reshape(len(ids), width)
    q = np.frombuffer(row["qvectors"], kind).reshape(len(qids), width)
    return ids, qids, (q @ c.T).astype(np.int64), np.frombuffer(row["state"], _KNOWN)


def _histograms(width: int, kind: str):
    """Partial histograms (qb, counts) of all pairs of a query block and a candidate block that a task holds."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ids, qids, scores, known = _scores(row, width, kind)
                counts = held.setdefault(row["qb"], np.zeros((len(qids), BINS), np.int64))
                for i in np.flatnonzero(known["phase"] < 2):
                    s, k = scores[i], known[i]
                    other = ids != qids[i]
                    if k["phase"] == 0:
                        s = s[other & (s >= k["lo"]) & (s < k["hi"])]
                    else:
                        tied = other & (s == k["value"]) & (ids >= k["lo"]) & (ids < k["hi"])
                        s = ids[tied]
                    counts[i] += np.bincount((s - k["lo"]) // k["width"], minlength=BINS)[:BINS]
                if len(held) > 32:
                    yield _partial(held)
                    held = {}
        if held:
            yield _partial(held)

    return run


def _partial(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())],
                                      names=["qb", "counts"])


def _narrow(ids_from: int, ids_to: int):
    """Moves each query to the bin that holds what it looks for."""

    def run(key, blocks: pd.DataFrame, partials: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return blocks
        row = blocks.iloc[0]
        known = np.frombuffer(row["state"], _KNOWN).copy()
        counts = np.zeros((len(known), BINS), np.int64)
        for part in partials["counts"]:
            counts += np.frombuffer(part, np.int64).reshape(len(known), BINS)
        for i in np.flatnonzero(known["phase"] < 2):
            k, own = known[i], counts[i]
            order = own[::-1] if k["phase"] == 0 else own
            sums = np.cumsum(order)
            if sums[-1] < k["need"]:
                k["phase"], k["value"], k["limit"] = 2, _LOWEST, _HIGHEST
                continue
            at = int(np.searchsorted(sums, k["need"]))
            k["need"] -= sums[at] - order[at]
            b = BINS - 1 - at if k["phase"] == 0 else at
            k["lo"] += b * k["width"]
            k["hi"] = min(int(k["hi"]), int(k["lo"]) + int(k["width"]))
            if k["width"] > 1:
                k["width"] = -(-(int(k["hi"]) - int(k["lo"])) // BINS)
            elif k["phase"] == 1:
                k["phase"], k["limit"] = 2, k["lo"]
            elif order[at] <= k["need"]:
                k["phase"], k["value"], k["limit"] = 2, k["lo"], _HIGHEST
            else:
                k["phase"], k["value"] = 1, k["lo"]
                k["lo"], k["hi"] = ids_from, min(ids_to + 1, _HIGHEST)
                k["width"] = -(-(int(k["hi"]) - int(k["lo"])) // BINS)
        return pd.DataFrame({"qb": [row["qb"]], "qids": [row["qids"]], "qvectors": [row["qvectors"]], "state": [known.tobytes()]})

    return run


def _select(width: int, kind: str):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, qids, scores, known = _scores(row, width, kind)
                value, limit = known["value"][:, None], known["limit"][:, None]
                good = (ids[None, :] != qids[:, None]) & ((scores > value) | ((scores == value) & (ids[None, :] <= limit)))
                q, c = np.nonzero(good)
                yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(ids[c]), pa.array(scores[q, c])],
                                                 names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query, ties to the smaller vec_id.

    Both tables have vec_id and embedding; a component x counts as floor(scale * x). Query blocks meet candidate blocks;
    each pass scores every pair again, and only histograms of 256 bins a query are shuffled and summed. A pass narrows each query's
    range to the bin of its kth score, until the score is known; if more candidates tie there than are wanted, the same
    selection goes on over their ids. So a vector that a third of the rows repeat adds counts, never rows. One more pass
    returns what lies above. A query never meets rows of its own id. Vectors that are null or hold null or non-finite
    components take no part on either side; shorter vectors count as filled up with 0, empty ones score 0; with fewer than k
    candidates all are returned. Repeated rows of an id count each and come one after another. Scores must stay
    below 2**53, else ValueError. Other columns are not read.
    """
    spark = vectors.sparkSession
    room = Workspace(spark, "topk")
    rows, asked = usable(vectors), usable(queries)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x) * scale + 1, F.lit(2.0)))
    about = [df.agg(F.count(F.lit(1)), F.max(F.size("embedding")), F.max(norm), F.min("vec_id"), F.max("vec_id")).collect()[0]
             for df in (rows, asked)]
    width = max(1, *(a[1] or 0 for a in about))
    top = int(np.ceil(np.sqrt((about[0][2] or 0.0) * (about[1][2] or 0.0)) * (1 + 1e-9))) + 1
    if top >= 1 << 53:
        raise ValueError("scores pass 2**53")
    kind = "float32" if max(about[0][2] or 0, about[1][2] or 0, top) < 1 << 24 else "float64"
    ids_from, ids_to = about[0][3] or 0, about[0][4] or 0
    start = np.zeros(1, _KNOWN)
    start["lo"], start["hi"], start["need"] = -top, top + 1, k
    start["width"] = -(-(2 * top + 1) // BINS)
    candidates = room.save(_blocks(rows, about[0][0], ROWS, width, scale, kind), "candidates")
    blocks = _blocks(asked, about[1][0], QUERIES, width, scale, kind)
    number = max(1, -(-about[1][0] // QUERIES))
    state = room.save(blocks.select(
        F.col("block").alias("qb"), F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"),
        F.expr(f"unhex(repeat('{start.tobytes().hex()}', cast(octet_length(ids) / 8 as int)))").alias("state")), "state")
    pairs = candidates.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(number - 1)))).withColumn("qb", F.col("qb").cast("int"))

    def units(state):
        return pairs.join(state, "qb").repartition("block", "qb")

    def left(state):
        def run(frames):
            for frame in frames:
                yield pd.DataFrame({"n": [sum(int((np.frombuffer(s, _KNOWN)["phase"] < 2).sum()) for s in frame["state"])]})

        return state.select("state").mapInPandas(run, "n long").agg(F.sum("n")).collect()[0][0] or 0

    while left(state):
        counts = units(state).mapInArrow(_histograms(width, kind), "qb int, counts binary")
        state = room.save(state.groupBy("qb").cogroup(counts.groupBy("qb")).applyInPandas(_narrow(ids_from, ids_to), _STATE), "state")
    room.keep(candidates, state)
    found = units(state).mapInArrow(_select(width, kind), "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
