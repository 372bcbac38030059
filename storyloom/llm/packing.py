"""Packing of documents into sequences of power-of-two lengths, none of which crosses documents."""

from __future__ import annotations

import os
import re
import zlib
from functools import cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators.ranks import positions
from storyloom.session import Workspace

from .textblocks import blocks

LIMIT = 4096
END = 2
#: ASCII punctuation that words are cut before; an apostrophe may belong to what follows it.
MARKS = ".,;:!?#%*&$"
#: Distinct words that a Python worker remembers with their ids, and bytes of texts that are split at a time.
MEMORY, SLICE = 1 << 20, 1 << 20
#: Words that the tokenizer sees at once.
TOGETHER = 1024

TOKENIZER = "word_bpe_49k.json"


class Encoder:
    """Ids of texts for tokenizers that drop white space, never join what stands on both sides of it, and never join an
    ASCII letter or digit with one of MARKS behind it.

    Pieces between white space and such places are encoded once and remembered by number, so the ids of a text are those
    of its pieces in a row, gathered at once. Once MEMORY pieces are remembered, others are encoded whenever they come:
    memory is bounded by MEMORY pieces and one slice of a text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        marks = "".join(m for m in MARKS if m not in special)
        self.place = re.compile(b"(?<=[A-Za-z0-9])(?=[" + re.escape(marks).encode() + b"])")
        self.known: dict[bytes, int] = {}
        self.flat, self.starts = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words and how many each has. The tokenizer reads them side by side; a token belongs to the word
        in which it starts."""
        ids, sizes = [], []
        for a in range(0, len(words), TOGETHER):
            some = [w.decode() for w in words[a : a + TOGETHER]]
            (found,) = self.tokenizer.encode_batch([" ".join(some)], add_special_tokens=False)
            first = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
            begins = np.cumsum([0] + [len(w) + 1 for w in some])
            ids.append(np.array(found.ids, "<u4"))
            sizes.append(np.diff(np.searchsorted(first, begins)))
        return np.concatenate(ids), np.concatenate(sizes)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        flat, starts, new = self.flat, self.starts, np.flatnonzero(at < 0)
        if len(new):
            some = [words[i] for i in new.tolist()]
            numbers: dict[bytes, int] = {}
            at[new] = np.fromiter((numbers.setdefault(w, len(numbers)) for w in some), np.int64, len(some)) + len(self.known)
            ids, sizes = self._ids(list(numbers))
            flat, starts = np.concatenate([flat, ids]), np.concatenate([starts, starts[-1] + np.cumsum(sizes)])
            if len(self.known) + len(numbers) <= MEMORY:
                self.known.update((w, len(starts) - 1 - len(numbers) + n) for w, n in numbers.items())
                self.flat, self.starts = flat, starts
        begin, sizes = starts[at], starts[at + 1] - starts[at]
        ends = np.cumsum(sizes)
        return flat[np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of every text. Short texts go together, long ones in slices that end at white space."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        words: list[bytes] = []
        owners: list[tuple[int, int]] = []

        def flush():
            ids, sizes = self.encode(words)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            for i, n in owners:
                out[i].append(ids[ends[at] : ends[at + n]])
                at += n
            words.clear()
            owners.clear()

        held = 0
        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = min(at + SLICE, len(text))
                while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
                    end += 1
                some = self.place.sub(b" ", text[at:end]).split()
                words.extend(some)
                owners.append((i, len(some)))
                held += end - at
                at = end
                if held >= SLICE:
                    flush()
                    held = 0
        flush()
        return [np.concatenate(x) if x else np.zeros(0, "<u4") for x in out]


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker: its words serve the tasks that follow."""
    return Encoder(path)


def cuts(total: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of total tokens: full lengths first, then the ones of the binary rest, longest first."""
    out = [(a, limit) for a in range(0, total - limit + 1, limit)]
    start, bit = len(out) * limit, limit >> 1
    while bit:
        if total - start & bit:
            out.append((start, bit))
            start += bit
        bit >>= 1
    return out


def pieces(docs: DataFrame, path: str, end: int = END, limit: int = LIMIT, ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids of every piece. No shuffle."""

    def cut(batches):
        for block in blocks(batches):
            rows, raw, kept = [], [], block.rows.column("doc_id").to_pylist()
            for doc, found in zip(kept, encoder(path).texts(block.texts)):
                whole = np.append(found, np.array([end], "<u4"))
                data = whole.astype("<u4", copy=False).tobytes()
                for start, length in cuts(len(whole), limit):
                    part = data[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(part), len(whole)))
                    if ids:
                        raw.append(whole[start : start + length].astype(np.int32))
            columns = list(zip(*rows))
            arrays = [pa.array(c, pa.int64()) for c in columns]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if ids:
                arrays.append(pa.array(raw, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def pack(docs: DataFrame, path: str | None = None, end: int = END, limit: int = LIMIT, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    A document is its ids and then ``end``. It is cut into lengths that are powers of two: as many of ``limit`` (itself a
    power of two) as fit, then one for each binary one of the rest. Every piece is a sequence, so none is padded and none
    holds two documents; sequences of a length are a bucket, and are numbered one after the other, bucket by bucket, by
    doc_id, start and checksum. Pieces are written before they are numbered: numbers come from ranges of the order and
    their sizes, so neither a long bucket nor a large table passes through one task.

    A null or empty text is one piece, of ``end`` alone. Rows that share an id, and rows without one, are documents of
    their own. An empty table gives an empty result. Extra columns are not read.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    spark = docs.sparkSession
    made = Workspace(spark, "packing").save(pieces(docs, path or public_tokenizers.path(TOKENIZER), end, limit, ids), "pieces")
    order = [F.asc("length"), F.asc_nulls_first("doc_id"), F.asc("start"), F.asc("ids_crc32"), F.asc("doc_tokens")]
    numbered = positions(made, order, "sequence_id").withColumn("offset", F.lit(0).cast("long"))
    return numbered.select(*made.columns[:5], F.col("sequence_id").cast("long"), "offset", *(["ids"] if ids else []))


def write_buckets(packed: DataFrame, folder: str) -> None:
    """Writes sequences to a folder per length, in the order of their numbers: batches of one bucket need no padding."""
    packed.repartitionByRange("length", "sequence_id").sortWithinPartitions("length", "sequence_id") \
        .write.mode("overwrite").partitionBy("length").parquet(folder)
