"""Quality by random Fourier features of document statistics, ridge regression and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from storyloom.session import Workspace

from .textblocks import SPACES, Block, Hasher, blocks, distinct_per_row, per_row, words
from .toxicity import marked

#: Labelled documents learnt from at most, the first by a hash of the id.
SAMPLE = 60_000
#: Random features, width of the Gaussian kernel in standard deviations, ridge penalty per row, calibration bins, seed.
FEATURES, WIDTH, RIDGE, BINS, SEED = 384, 4.0, 1e-4, 400, 11
#: Every n-th row of the sample by hash is kept from the fit and calibrates.
HELD = 4

STATISTICS = ("log_words", "log_bytes", "mean_word", "long_words", "short_words", "distinct_words", "upper", "digits",
              "spaces", "stops", "pipes", "symbols", "bangs", "non_ascii", "odd_words", "log_lines", "mean_line",
              "repeated_lines", "short_lines", "top_word", "repeated_pairs", "marks_in_words", "title_words", "letters")

_CLASSES = {}
for _name, _bytes in (("upper", range(65, 91)), ("digits", range(48, 58)), ("stops", b".,;:?"), ("pipes", b"|"),
                      ("symbols", b"#$%&*<>=_{}[]\\^~@/+"), ("bangs", b"!"), ("non_ascii", range(128, 256)),
                      ("letters", [*range(65, 91), *range(97, 123)])):
    _CLASSES[_name] = np.zeros(256, bool)
    _CLASSES[_name][list(_bytes)] = True


def statistics(block: Block) -> np.ndarray:
    """A row of STATISTICS for each text; an empty text has zeros."""
    n, out = len(block), {}
    raw, size = block.raw, np.maximum(block.lengths, 1)
    rows_at = block.offsets[:-1]

    def share(mask):
        return np.add.reduceat(mask, rows_at, dtype=np.int64) / size

    starts, ends = words(raw, SPACES)
    counts = per_row(starts, block.offsets)
    some = np.maximum(counts, 1)
    rows = np.repeat(np.arange(n), counts)
    lengths = ends - starts

    def mean(values):
        return np.bincount(rows, weights=values, minlength=n) / some

    hasher = Hasher(block.lower())
    hashes = hasher.pieces(starts, ends)
    _, owner, runs = distinct_per_row(hashes, rows)
    top = np.zeros(n)
    np.maximum.at(top, owner, runs)
    out["log_words"], out["log_bytes"] = np.log1p(counts), np.log1p(block.lengths)
    out["mean_word"], out["long_words"], out["short_words"] = mean(lengths), mean(lengths > 12), mean(lengths < 4)
    out["distinct_words"], out["top_word"] = np.bincount(owner, minlength=n) / some, top / some
    for name, members in _CLASSES.items():
        out[name] = share(members[raw])
    out["spaces"] = share(SPACES[raw]) - 1 / size
    last = raw[ends - 1] if len(ends) else raw[:0]
    first = raw[starts] if len(starts) else raw[:0]
    out["odd_words"] = mean(_CLASSES["symbols"][last] | _CLASSES["bangs"][last] | _CLASSES["pipes"][first])
    out["title_words"] = mean(_CLASSES["upper"][first])
    marks = np.concatenate([[0], np.cumsum(_CLASSES["symbols"][raw] | _CLASSES["bangs"][raw])])
    out["marks_in_words"] = mean((marks[ends] - marks[starts]) > 1)
    pair = hashes[:-1] * np.uint64(3) + hashes[1:] if len(hashes) > 1 else hashes[:0]
    near = rows[:-1] == rows[1:] if len(rows) > 1 else np.zeros(0, bool)
    _, pair_owner, _ = distinct_per_row(pair[near], rows[1:][near] if len(rows) > 1 else rows[:0])
    out["repeated_pairs"] = 1 - np.bincount(pair_owner, minlength=n) / np.maximum(counts - 1, 1)
    out["repeated_pairs"][counts < 2] = 0
    breaks = np.zeros(256, bool)
    breaks[10] = True
    cut = raw.copy()
    cut[block.offsets[1:] - 1] = 10
    line_at, line_end = words(cut, breaks)
    lines = per_row(line_at, block.offsets)
    line_rows = np.repeat(np.arange(n), lines)
    _, line_owner, _ = distinct_per_row(hasher.pieces(line_at, line_end), line_rows)
    many = np.maximum(lines, 1)
    out["log_lines"] = np.log1p(lines)
    out["mean_line"] = np.log1p(np.bincount(line_rows, weights=line_end - line_at, minlength=n) / many)
    out["repeated_lines"] = np.where(lines > 0, 1 - np.bincount(line_owner, minlength=n) / many, 0)
    out["short_lines"] = np.bincount(line_rows, weights=line_end - line_at < 20, minlength=n) / many
    return np.stack([np.asarray(out[k], float) for k in STATISTICS], axis=1)


@dataclass
class Model:
    """Everything that a score needs; its size depends on the parameters alone."""

    mean: np.ndarray
    spread: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        waves = np.sqrt(2.0 / len(self.phase)) * np.cos(z @ self.omega + self.phase)
        return np.concatenate([np.ones((len(x), 1)), z, waves], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.levels)


def _isotonic(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Non-descending weighted fit by pooling neighbours."""
    blocks_: list[list[float]] = []
    for w, v in zip(weight, value):
        blocks_.append([w, v, 1])
        while len(blocks_) > 1 and blocks_[-2][1] >= blocks_[-1][1]:
            w2, v2, n2 = blocks_.pop()
            w1, v1, n1 = blocks_[-1]
            blocks_[-1] = [w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2]
    return np.concatenate([np.full(int(n), v) for _, v, n in blocks_]) if blocks_ else np.zeros(0)


def _summed(rows: DataFrame, make, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all partitions of an array that each makes of its rows (statistics, label, key)."""

    def run(frames):
        total = np.zeros(shape)
        for frame in frames:
            if len(frame):
                x = np.frombuffer(b"".join(frame["x"]), np.float64).reshape(len(frame), -1)
                total += make(x, frame["label"].to_numpy(float), frame["key"].to_numpy(np.int64))
        yield pd.DataFrame({"part": [total.tobytes()]})

    out = np.zeros(shape)
    for r in rows.mapInPandas(run, "part binary").toLocalIterator():
        out += np.frombuffer(r["part"], np.float64).reshape(shape)
    return out


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> Model:
    """Model from docs (doc_id, text) and labels (doc_id, column), picked by ``toxicity.marked``.

    Means, spreads, normal equations and the calibration histogram are sums over partitions; what reaches the driver is as
    large as the parameters say. One row in ``HELD`` calibrates and does not fit. Without rows every score is 0.5.
    """
    spark = docs.sparkSession
    picked = marked(docs, labels, column, sample)

    def extract(batches):
        for block in blocks(batches):
            x = statistics(block)
            yield pa.RecordBatch.from_arrays(
                [block.rows.column("key"), block.rows.column("label"), pa.array([r.tobytes() for r in x], pa.binary())],
                names=["key", "label", "x"])

    rows = Workspace(spark, "quality").save(picked.mapInArrow(extract, "key long, label int, x binary"), "statistics")
    d = len(STATISTICS)
    sums = _summed(rows, lambda x, y, k: np.stack([np.full(d, len(x)), x.sum(0), (x * x).sum(0)]), (3, d))
    count = max(sums[0, 0], 1)
    mean = sums[1] / count
    spread = np.sqrt(np.maximum(sums[2] / count - mean * mean, 0))
    spread[spread < 1e-9] = 1
    rng = np.random.default_rng(SEED)
    model = Model(mean, spread, rng.normal(size=(d, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES),
                  np.zeros(1 + d + FEATURES), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    if not sums[0, 0]:
        return model
    width = 1 + d + FEATURES

    def equations(x, y, key):
        fit = key % HELD != 0
        a = np.concatenate([model.lift(x[fit]), y[fit, None]], axis=1)
        return a.T @ a

    total = _summed(rows, equations, (width + 1, width + 1))
    penalty = np.full(width, RIDGE * max(total[0, 0], 1))
    penalty[0] = 1e-9
    model.weights = np.linalg.solve(total[:-1, :-1] + np.diag(penalty) + 1e-9 * np.eye(width), total[:-1, -1])
    edges = np.linspace(-0.5, 1.5, BINS + 1)

    def calibrate(x, y, key):
        x, y = x[key % HELD == 0], y[key % HELD == 0]
        at = np.clip(np.searchsorted(edges, model.raw(x)) - 1, 0, BINS - 1)
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)])

    seen, ones = _summed(rows, calibrate, (2, BINS))
    full = seen > 0
    if full.any():
        level = _isotonic(seen[full], ones[full] / seen[full])
        model.edges, model.levels = ((edges[:-1] + edges[1:]) / 2)[full], level
    else:
        model.edges, model.levels = edges, np.clip(edges, 0, 1)
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and score of every row, from its whole text.

    A null or empty text has all statistics 0 and gets the score of those. Rows that repeat score alike: to 12 digits, as sums vary beyond. Columns that are
    not kept are not read; a kept column must not be called ``score``.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for block in blocks(batches):
            columns = [block.rows.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.round(np.clip(held.value.score(statistics(block)), 0, 1), 12))],
                                             names=[*keep, "score"])

    rows = docs.select(*keep, *(["text"] if "text" not in keep else []))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in keep)
    return rows.mapInArrow(run, f"{schema}, score double")
