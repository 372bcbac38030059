"""Periodic runs of words by seeds of guaranteed overlap, extended along diagonals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import blocks

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _extent(ids: np.ndarray, i: int, lag: int, step: int) -> int:
    """How many positions from i on, in the direction of step, equal the position lag later. Read in growing pieces."""
    size, done, last = 64, 0, len(ids) - lag
    while True:
        at = i + step * done
        a, b = (at, min(at + size, last)) if step > 0 else (max(at - size + 1, 0), at + 1)
        if a >= b:
            return done
        same = ids[a:b] == ids[a + lag : b + lag]
        if step < 0:
            same = same[::-1]
        if not same.all():
            return done + int(same.argmin())
        done += b - a
        size *= 2


def maximal_runs(words: np.ndarray, counts: np.ndarray, least: int = 6, times: int = 4):
    """(text, start, length, period) of every maximal run of at least ``least`` words and ``times`` periods.

    words: word ids of texts side by side; counts: words of each text. Lags are taken in classes [2**j, 2**(j + 1)). A run
    of such a period matches itself at that lag over at least k = max(least, times * 2**j) - 2**j words, so k-grams are
    indexed; as k is at least the lag, a gram inside a run comes again first after exactly one smallest period, and
    neighbouring occurrences are the only pairs that need a look. Grams are named exactly, by doubling: what occurs once
    in its text is dropped before it is doubled. A seed is extended both ways unless the furthest place that its lag has
    covered lies beyond it.
    """
    if times < 3:
        raise ValueError("times must be 3 or more: shorter grams would not tell a period from its multiples")
    n, owner = len(words), np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    if not n:
        return []
    _, ids = np.unique(owner * (int(words.max()) + 1) + words, return_inverse=True)
    names, at, power, found, j = ids.astype(np.int64), np.arange(n), 0, [], 0
    seen = np.bincount(ids)[ids] > 1
    at = at[seen]
    full = np.full(n, -1, np.int64)
    full[at] = names[at]

    def pairs(places: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of a gram with a named gram ahead of it in the same text, and one key for both."""
        places = places[places + ahead < n]
        both = (full[places + ahead] >= 0) & (owner[places] == owner[np.minimum(places + ahead, n - 1)])
        places = places[both]
        return places, full[places] * (n + 1) + full[places + ahead]

    longest = int(counts.max())
    while len(at) and max(least, times << j) <= longest:
        k = max(least, times << j) - (1 << j)
        while 2 << power <= k and len(at):
            at, keys = pairs(at, 1 << power)
            _, named, often = np.unique(keys, return_inverse=True, return_counts=True)
            more = often[named] > 1
            full = np.full(n, -1, np.int64)
            at, power = at[more], power + 1
            full[at] = named[more]
        places, keys = pairs(at, k - (1 << power)) if k > 1 << power else (at, full[at])
        order = np.argsort(keys, kind="stable")
        places, keys = places[order], keys[order]
        lag = places[1:] - places[:-1]
        hit = (keys[1:] == keys[:-1]) & (lag >= 1 << j) & (lag < 2 << j)
        seed, lag = places[:-1][hit], lag[hit]
        order = np.lexsort((seed, lag))
        seed, lag = seed[order], lag[order]
        head = np.ones(len(seed), bool)
        head[1:] = (lag[1:] != lag[:-1]) | (seed[1:] != seed[:-1] + 1)
        covered: dict[int, int] = {}
        for i, q in zip(seed[head].tolist(), lag[head].tolist()):
            if i < covered.get(q, 0):
                continue
            right = i + k + _extent(ids, i + k, q, 1)
            left = i - _extent(ids, i - 1, q, -1)
            covered[q] = right
            if right - left + q >= max(least, times * q):
                text = int(owner[i])
                found.append((text, left - int(begin[text]), right - left + q, q))
        j += 1
    return sorted(found, key=lambda r: (r[0], r[1], r[3]))


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every document.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a maximal stretch of words with smallest period q and at
    least max(least, times * q) words; ``runs`` has start, length and period by start, then period. ``collapsed`` is the
    text without the words that lie in a run behind its first q words, single-spaced.

    No shuffle: a text is seen whole in one task, a block of texts at a time, in time n log n squared. A null or wordless
    text has no runs and collapses to an empty text. Repeated rows and rows without an id are judged each on their own.
    Equal lags and overlapping runs are all listed. An empty table gives an empty result. Extra columns are not read.
    """

    def find(batches):
        for block in blocks(batches):
            split = [t.split() for t in block.texts]
            counts = np.fromiter(map(len, split), np.int64, len(split))
            seen: dict[bytes, int] = {}
            flat = np.fromiter((seen.setdefault(w, len(seen)) for ws in split for w in ws), np.int64, int(counts.sum()))
            runs: list[list[dict]] = [[] for _ in split]
            keep: dict[int, np.ndarray] = {}
            for text, start, length, period in maximal_runs(flat, counts, least, times):
                runs[text].append({"start": start, "length": length, "period": period})
                keep.setdefault(text, np.ones(counts[text], bool))[start + period : start + length] = False
            left = [[split[i][x] for x in np.flatnonzero(keep[i]).tolist()] if i in keep else ws for i, ws in enumerate(split)]
            yield pa.RecordBatch.from_arrays(
                [block.rows.column("doc_id"), pa.array(counts), pa.array(runs, pa.list_(_RUN)),
                 pa.array([b" ".join(ws) for ws in left], pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, _OUT)


def repeat_some(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, of which about a tenth, by crc32 of the id, repeat a passage of theirs to the end.

    With g = floor(crc32 / 10), the words from a = g % n on are the next p = 1 + floor((n - a) / (3 + g % 8)) words over
    and over. Rows without an id or without words stay as they are.
    """
    text, crc = F.col("text").cast("string"), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    g = F.floor(crc / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    again = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return docs.select(F.col("doc_id").cast("long"),
                       F.when((crc % 10 == 0) & (F.coalesce(n, F.lit(0)) > 0), again).otherwise(text).alias("text"))
