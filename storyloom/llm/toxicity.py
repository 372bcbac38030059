"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.session import Workspace

from .tables import fold
from .textblocks import MARKS, Block, Hasher, blocks, mix, per_row, words

#: Features are hashed to this many coordinates: the weights have a fixed size, whatever the corpus.
BITS = 20
#: At most so many labelled documents are learnt from (the first by a hash of the id).
SAMPLE = 40_000
#: Parts of the sample that are learnt side by side, and rounds after which their states are averaged.
SHARDS, ROUNDS = 6, 4
#: Files that the sample is bucketed to; the parts fall into different ones.
BUCKETS = 17
#: Slices of the coordinates, each averaged by a task of its own.
SLICES = 16
#: Rates and penalties: per-coordinate step alpha, beta; lambda1, lambda2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.0, 0.1
#: Lengths in bytes of the word beginnings that count beside the whole word.
STEMS = (4, 5, 6)
#: Distances of the second word of a pair: 1 is a bigram, more are skip-grams.
GAPS = (1, 2, 3)


def features(block: Block, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and the row of each, in no order, repeats included: words, their beginnings, pairs of words."""
    data = block.lower()
    starts, ends = words(data, MARKS)
    counts = per_row(starts, block.offsets)
    rows = np.repeat(np.arange(len(block), dtype=np.int32), counts)
    hasher = Hasher(data)
    whole = hasher.pieces(starts, ends)
    out, owner = [whole], [rows]
    for n in STEMS:
        longer = ends - starts > n
        out.append(mix(hasher.pieces(starts[longer], starts[longer] + n) + np.uint64(n)))
        owner.append(rows[longer])
    for gap in GAPS:
        if len(whole) > gap:
            near = rows[:-gap] == rows[gap:]
            out.append(mix(whole[:-gap] * np.uint64(2 * gap + 1) + whole[gap:])[near])
            owner.append(rows[gap:][near])
    return (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int32), np.concatenate(owner)


@dataclass
class Model:
    """Sparse weights and the intercept; coordinates ascend."""

    coordinates: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.coordinates] = self.weights
        return out


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _pass(rows: list[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray, order: np.ndarray) -> None:
    """One pass of per-coordinate updates; the last coordinate is the intercept, without penalty."""
    last = len(z) - 1
    for i in order:
        at, label = rows[i]
        zi, ni = z[at], n[at]
        w = _weights(zi, ni)
        w0 = -z[last] / ((BETA + np.sqrt(n[last])) / ALPHA)
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + w0, -35, 35)))
        g = p - label
        grown = ni + g * g
        z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
        n[at] = grown
        step = (np.sqrt(n[last] + g * g) - np.sqrt(n[last])) / ALPHA
        z[last] += g - step * w0
        n[last] += g * g


def marked(docs: DataFrame, labels: DataFrame, column: str, sample: int, folds: int = 5) -> DataFrame:
    """key, label and text of the documents to learn from.

    Ids whose crc32 as text is 0 modulo ``folds`` teach nothing, nor do labels other than 0 and 1. Of the rest the first
    ``sample`` by a hash of the id are taken, the documented bound, which also bounds what is broadcast to find their texts.
    A document with several labels teaches each once; a label without a document is passed over.
    """
    room = Workspace(docs.sparkSession, "marked")
    marks = labels.select(F.col("doc_id").alias("marked"), F.col(column).cast("int").alias("label")) \
        .where(F.col("label").isin(0, 1) & (fold(F.col("marked"), folds) != 0)).distinct() \
        .select("marked", "label", F.xxhash64(F.col("marked").cast("string")).alias("key")) \
        .orderBy("key", "label").limit(sample)
    marks = room.save(marks, "marks")
    return docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")) \
        .join(F.broadcast(marks), F.col("id") == F.col("marked")).select("key", "label", "text")


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", bits: int = BITS, sample: int = SAMPLE) -> Model:
    """Model from docs (doc_id, text) and labels (doc_id, column), see ``marked``.

    Presence of a feature counts, not how often it occurs, so long texts are not favoured. The sample is dealt over
    ``SHARDS`` parts by a hash of the id, once, as a table bucketed by part: rounds read it and shuffle no texts. Each part
    goes on from the averaged state of all parts, ``ROUNDS`` times, and sends what it changed of it. States are averaged in
    tasks, slice by slice; the driver sees one state of fixed size. Without rows to learn from every score is 0.5.
    """
    spark = docs.sparkSession
    room = Workspace(spark, "toxicity")
    name, path = f"toxicity_{uuid.uuid4().hex}", f"{room.root}/sample"
    marked(docs, labels, column, sample).withColumn("part", F.pmod("key", F.lit(SHARDS)).cast("int")).repartition(BUCKETS, "part") \
        .write.bucketBy(BUCKETS, "part").option("path", path).option("compression", "zstd").saveAsTable(name)
    rows = spark.table(name)
    room.saved.append((rows, path))
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    for turn in range(ROUNDS):
        held = spark.sparkContext.broadcast((z, n))

        def learn(key, frame):
            frame = frame.sort_values(["key", "label", "text"], kind="stable")
            z, n = (x.copy() for x in held.value)
            own = []
            for block in blocks(pa.Table.from_pandas(frame[["text", "label"]], preserve_index=False).to_batches()):
                found, owner = features(block, bits)
                both = np.unique(owner.astype(np.int64) << np.int64(bits) | found)
                ends = np.searchsorted(both >> bits, np.arange(len(block) + 1))
                found = (both & ((1 << bits) - 1)).astype(np.int32)
                own += [(found[a:b], y) for a, b, y in zip(ends[:-1], ends[1:], block.column("label"))]
            _pass(own, z, n, np.random.default_rng(turn).permutation(len(own)))
            changed = [s[(z[s] != held.value[0][s]) | (n[s] != held.value[1][s])] for s in np.array_split(np.arange(len(z)), SLICES)]
            return pd.DataFrame({"slice": range(SLICES), "rows": len(own), "at": [s.astype(np.int32).tobytes() for s in changed],
                                 "z": [z[s].astype(np.float32).tobytes() for s in changed], "n": [n[s].astype(np.float32).tobytes() for s in changed]})

        def average(key, frame):
            frame = frame.sort_values(["rows", "z"], kind="stable")
            slot = np.array_split(np.arange(len(held.value[0])), SLICES)[key[0]]
            out = []
            for column, before in zip(("z", "n"), held.value):
                mean, total = before[slot].copy(), max(frame["rows"].sum(), 1)
                for r, at, x in zip(frame["rows"], frame["at"], frame[column]):
                    at = np.frombuffer(at, np.int32)
                    mean[at - slot[0]] += r / total * (np.frombuffer(x, np.float32) - before[at])
                out.append(mean.tobytes())
            return pd.DataFrame({"slice": [key[0]], "rows": [1], "at": [b""], "z": [out[0]], "n": [out[1]]})

        state = "slice long, rows long, at binary, z binary, n binary"
        merged = rows.groupBy("part").applyInPandas(learn, state).groupBy("slice").applyInPandas(average, state)
        ends = np.cumsum([0, *map(len, np.array_split(np.arange(len(z)), SLICES))])
        for r in merged.select("slice", "z", "n").toLocalIterator():
            z[ends[r["slice"]]:ends[r["slice"] + 1]] = np.frombuffer(r["z"], np.float64)
            n[ends[r["slice"]]:ends[r["slice"] + 1]] = np.frombuffer(r["n"], np.float64)
        held.unpersist()
    spark.sql(f"DROP TABLE {name}")
    room.keep()
    w = _weights(z[:-1], n[:-1])
    at = np.flatnonzero(w)
    bias = float(-z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA))
    return Model(at.astype(np.int32), w[at].astype(np.float32), bias, bits)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns and ``name``, the probability of label 1, of every row; the whole text counts.

    A null, empty or wordless text gets the intercept's score. Rows that repeat get the same score. Columns of docs that are
    not kept are not read, so their names can't clash; no kept column may have that name.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        dense = model.dense()
        bits = model.bits
        for block in blocks(batches):
            found, owner = features(block, bits)
            live = dense[found] != 0
            both = np.unique(owner[live].astype(np.int64) << np.int64(bits) | found[live])
            sums = np.bincount(both >> bits, weights=dense[both & ((1 << bits) - 1)], minlength=len(block)) + model.bias
            columns = [block.rows.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(1.0 / (1.0 + np.exp(-np.clip(sums, -700, 700))))],
                                             names=[*keep, name])

    rows = docs.select(*keep, *(["text"] if "text" not in keep else []))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in keep)
    return rows.mapInArrow(run, f"{schema}, `{name}` double")

