"""Language-model scores by context-tree weighting over the binary-decomposed bytes of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.session import Workspace

from .tables import fold, parts
from .textblocks import SPACES, Block, Hasher, blocks, per_row, release, words

#: Bytes of context, five at most (keys leave 16 bits free for the number of a text in its batch); what stands before a text, and its end.
DEPTH, START, END = 5, 10, 10
#: Text of a batch, whose distinct words and contexts are counted and looked up together.
BATCH_BYTES = 3 << 20
#: Batches whose counts one task adds up; bytes of questions that one task answers.
FAN_IN, ANSWER_BYTES = 32, 32 << 20
#: Bytes of texts that are scored at a time.
PIECE = 1 << 20

_BITS = 8
_LOG2 = np.log(2.0)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shifted, product = x + 8.0, np.ones_like(x)
    for i in range(8):
        product *= x + i
    inv = 1.0 / shifted
    return ((shifted - 0.5) * np.log(shifted) - shifted + 0.5 * np.log(2 * np.pi) + inv / 12 - inv**3 / 360 + inv**5 / 1260
            - np.log(product))


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov estimate of a zeros and b ones in any order."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - np.log(np.pi)


def stream(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that are scored: of each text its words, A-Z in lower case, with one space between them, and END. Also
    where each text begins, the text of each byte, and the starts and ends of words in the block."""
    data = block.lower().copy()
    starts, ends = words(data, SPACES)
    counts = per_row(starts, block.offsets)
    keep = ~SPACES[data]
    data[ends], keep[ends] = 32, True
    last = np.cumsum(counts)
    close = np.where(counts > 0, ends[np.maximum(last - 1, 0)] if len(ends) else 0, block.offsets[1:] - 1)
    data[close], keep[close] = END, True
    owner = np.repeat(np.arange(len(block), dtype=np.int32), np.diff(block.offsets))[keep]
    return data[keep], np.searchsorted(owner, np.arange(len(block))), owner, starts, ends


def byte_keys(data: np.ndarray, begins: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each byte its context, latest byte first, and the byte, in one number. Contexts reach across words to the start
    of the text and are filled with START beyond it."""
    wide = data.astype(np.uint64)
    keys = wide.copy()
    for d in range(1, DEPTH + 1):
        keys[d:] |= wide[:-d] << np.uint64(8 * (DEPTH + 1 - d))
    # the first bytes of a text, whose contexts reach beyond it
    for k in range(DEPTH):
        at = begins + k
        inside = at < len(data)
        at = at[inside][owner[at[inside]] == np.flatnonzero(inside)]
        near = wide[at]
        for d in range(1, DEPTH + 1):
            near |= (wide[at - d] if d <= k else np.uint64(START)) << np.uint64(8 * (DEPTH + 1 - d))
        keys[at] = near
    return keys


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed planes of bytes of their differences."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return len(keys).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(steps).tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(pa.decompress(raw[4:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where each distinct key of sorted ones begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))


def _sum_sorted(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    first = _firsts(keys)
    return keys[first], *(np.add.reduceat(v, first) if len(first) else v[:0] for v in values)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    return _sum_sorted(keys[order], *(v[order] for v in values))


class Tree:
    """Nodes of the context trees of all bit positions, from one depth on down to DEPTH.

    A node is a context of d bytes and the bits of the current byte so far; it has counts of the next bit and the weight
    that context-tree weighting gives to its own estimate against its children's. Keys are sorted and distinct; the nodes of
    a depth are summed up from those of the depth below.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, top: int):
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        self.top = top
        symbol = keys & np.uint64(255)
        for j in range(_BITS):
            one = (symbol >> np.uint64(_BITS - 1 - j) & np.uint64(1)).astype(bool)
            name = keys - symbol | symbol >> np.uint64(_BITS - j)
            node, zeros, ones = _sum_sorted(name, np.where(one, 0, counts), np.where(one, counts, 0))
            whole = _log_kt(zeros.astype(float), ones.astype(float))
            self.nodes[DEPTH, j] = (node, zeros, ones, whole, np.ones(len(node)))
            for d in range(DEPTH - 1, top - 1, -1):
                parent = (node >> np.uint64(16)) << np.uint64(8) | node & np.uint64(255)
                node, zeros, ones, children = _sum_by(parent, zeros, ones, whole)
                own = _log_kt(zeros.astype(float), ones.astype(float))
                whole = np.logaddexp(own, children) - _LOG2
                self.nodes[d, j] = (node, zeros, ones, whole, np.exp(own - _LOG2 - whole))

    def blend(self, keys: np.ndarray, j: int, upper: "Upper") -> np.ndarray:
        """Probability of bit j of each key's byte in its context."""
        symbol = keys & np.uint64(255)
        one = (symbol >> np.uint64(_BITS - 1 - j) & np.uint64(1)).astype(bool)
        p = np.full(len(keys), 0.5)
        for d in range(DEPTH, self.top - 1, -1):
            node, zeros, ones, _, weight = self.nodes[d, j]
            name = (keys >> np.uint64(8 * (DEPTH - d) + 8)) << np.uint64(8) | symbol >> np.uint64(_BITS - j)
            at = np.minimum(np.searchsorted(node, name), max(len(node) - 1, 0))
            if not len(node):
                continue
            known = node[at] == name
            kt = (np.where(one, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1.0)
            p = np.where(known, weight[at] * kt + (1 - weight[at]) * p, 0.5)
        return upper.blend(keys, j, one, p)


class Upper:
    """Depths 0 and 1 of the trees, as dense tables of fixed size."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, whole: np.ndarray):
        """Each (256 contexts of one byte, 256 node names of the byte so far); whole is the product of the children."""
        self.tables = []
        own = np.where(zeros + ones > 0, _log_kt(zeros, ones), 0.0)
        first = np.where(zeros + ones > 0, np.logaddexp(own, whole) - _LOG2, 0.0)
        self.tables.append((zeros, ones, np.where(zeros + ones > 0, np.exp(own - _LOG2 - first), 1.0)))
        z, o = zeros.sum(0, keepdims=True), ones.sum(0, keepdims=True)
        own = np.where(z + o > 0, _log_kt(z, o), 0.0)
        both = np.where(z + o > 0, np.logaddexp(own, first.sum(0, keepdims=True)) - _LOG2, 0.0)
        self.tables.append((z, o, np.where(z + o > 0, np.exp(own - _LOG2 - both), 1.0)))

    def blend(self, keys, j, one, p):
        latest = (keys >> np.uint64(8 * DEPTH)).astype(np.int64)
        name = ((keys & np.uint64(255)) >> np.uint64(_BITS - j)).astype(np.int64) + (1 << j)
        for (zeros, ones, weight), row in zip(self.tables, (latest, np.zeros_like(latest))):
            z, o, w = zeros[row, name], ones[row, name], weight[row, name]
            p = np.where(z + o > 0, w * (np.where(one, o, z) + 0.5) / (z + o + 1.0) + (1 - w) * p, 0.5)
        return p


def _own_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, groups: int):
    """Distinct words of a batch in the order of their groups, the number of each word there, and where groups begin."""
    hashes = Hasher(data).pieces(starts, ends)
    distinct, first, tokens = np.unique(hashes, return_index=True, return_inverse=True)
    group = (distinct % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return first[order], place[tokens], np.searchsorted(group[order], np.arange(groups + 1))


def _batched(docs: DataFrame, groups: int, folds: int, apart: int) -> DataFrame:
    """A row for each batch of texts: the documents, their compressed bytes, the distinct words dealt into groups, and the
    distinct contexts by stem, each with how often the learnt texts have it."""

    def run(batches):
        task, serial = TaskContext.get().partitionId(), 0
        for block in blocks(batches, limit=BATCH_BYTES):
            data, begins, owner, starts, ends = stream(block)
            held = block.column("held").astype(bool)
            lower = block.lower()
            first, tokens, cuts = _own_words(lower, starts, ends, groups)
            learnt = np.repeat(~held, per_row(starts, block.offsets))
            seen = np.bincount(tokens[learnt], minlength=len(first))
            text = lower.tobytes()
            names = [text[starts[i]:ends[i]] for i in first]
            blobs = [b"".join(x + b" " for x in names[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            numbers = [seen[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            # one sort of the keys, each with a bit that says whether it is learnt
            every = byte_keys(data, begins, owner) << np.uint64(1) | (~held[owner]).astype(np.uint64)
            every.sort()
            keys, often = _sum_sorted(every >> np.uint64(1), (every & np.uint64(1)).astype(np.int64))
            stems = [{"stem": s, "keys": _pack(k), "n": pa.compress(c["n"].astype("<i4").tobytes(), codec="zstd", asbytes=True)}
                     for s, k, c in _by_stem(keys, n=often)]
            yield pa.RecordBatch.from_pydict({
                "batch": pa.array([(task << 32) + serial], pa.int64()), "ids": pa.array([block.rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "held": pa.array([held.astype(np.uint8).tobytes()], pa.binary()),
                "lengths": pa.array([np.diff(np.append(begins, len(data))).astype("<i8").tobytes()], pa.binary()),
                "size": pa.array([len(data)], pa.int64()), "data": pa.array([pa.compress(data.tobytes(), codec="zstd", asbytes=True)], pa.binary()),
                "words": pa.array([blobs], pa.list_(pa.binary())), "seen": pa.array([numbers], pa.list_(pa.binary())),
                "stems": pa.array([stems], pa.list_(pa.struct([("stem", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])))})
            serial += 1

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold(F.col("doc_id"), folds) == apart, F.lit(False)).alias("held"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "batch long, ids array<long>, held binary, lengths binary, size long, data binary, words array<binary>, "
                                "seen array<binary>, stems array<struct<stem: int, keys: binary, n: binary>>")


def _vocabulary(key, frame: pd.DataFrame) -> pd.DataFrame:
    """Distinct words of a group over all batches, and how often the learnt texts have them."""
    block = Block(None, [b"".join(frame["words"])])
    starts, ends = words(block.raw, SPACES)
    counts = np.concatenate([np.frombuffer(x, "<i4") for x in frame["seen"]]).astype(np.int64)
    hashes = Hasher(block.raw).pieces(starts, ends)
    distinct, at = np.unique(hashes, return_inverse=True)
    sums = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
    return pd.DataFrame({"group": [key[0]], "known": [int((sums > 0).sum())], "total": [int(sums.sum())],
                         "hashes": [distinct.tobytes()], "seen": [sums.tobytes()]})


def _by_stem(keys: np.ndarray, **columns: np.ndarray):
    """Slices of sorted keys that share their two latest context bytes."""
    stem = (keys >> np.uint64(8 * (DEPTH - 1))).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), stem[1:] != stem[:-1]]))
    for a, b in zip(cuts, np.append(cuts[1:], len(keys))):
        yield int(stem[a]), keys[a:b], {c: v[a:b] for c, v in columns.items()}


def _counts(raw: bytes, n: int, width: int) -> np.ndarray:
    data = pa.decompress(raw, decompressed_size=width * n, codec="zstd", asbytes=True)
    return np.frombuffer(data, "<i4" if width == 4 else "<i8").astype(np.int64)


def _joined(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys of several rows and their summed counts; keys that no learnt text has go."""
    keys = [_unpack(x) for x in frame["keys"]]
    counts = [_counts(x, len(k), w) for x, k, w in zip(frame["n"], keys, frame["width"])]
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    return _sum_by(keys[counts > 0], counts[counts > 0])


def _merged(key, frame: pd.DataFrame) -> pd.DataFrame:
    keys, counts = _joined(frame)
    return pd.DataFrame({"stem": [key[0]], "part": [key[1]], "keys": [_pack(keys)], "width": [8],
                         "n": [pa.compress(counts.astype("<i8").tobytes(), codec="zstd", asbytes=True)]})


def _subtree(key, frame: pd.DataFrame) -> pd.DataFrame:
    """Counts of a stem, summed, and what its node of depth 2 passes upward."""
    keys, counts = _joined(frame)
    tree = Tree(keys, counts, 2)
    zeros, ones, whole = np.zeros(256), np.zeros(256), np.zeros(256)
    for j in range(_BITS):
        node, z, o, w, _ = tree.nodes[2, j]
        at = (node & np.uint64(255)).astype(np.int64) + (1 << j)
        zeros[at], ones[at], whole[at] = z, o, w
    n = pa.compress(counts.astype("<i8").tobytes(), codec="zstd", asbytes=True)
    return pd.DataFrame([(key[0], key[0] >> 8, _pack(keys), n, np.concatenate([zeros, ones, whole]).tobytes())],
                        columns=["stem", "latest", "keys", "n", "up"])


def _latest(key, frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.float64) for x in sorted(frame["up"]))
    return pd.DataFrame({"latest": [key[0]], "up": [total.tobytes()]})


def _answers(held):
    def run(key, known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"batch": [], "stem": [], "logs": []})
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(known):
            keys = _unpack(known["keys"].iloc[0])
            counts = _counts(known["n"].iloc[0], len(keys), 8)
        tree = Tree(keys, counts, 2)
        lists = [_unpack(x) for x in asked["keys"]]
        distinct = np.unique(np.concatenate(lists))
        logs = sum(np.log10(tree.blend(distinct, j, held.value)) for j in range(_BITS)).astype(np.float32)
        return pd.DataFrame({"batch": asked["batch"], "stem": key[0],
                             "logs": [logs[np.searchsorted(distinct, x)].tobytes() for x in lists]})

    return run


def _word_counts(key, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """For each batch that has words of this group, in its order, how often the learnt texts have them."""
    names, counts = np.frombuffer(own["hashes"].iloc[0], np.uint64), np.frombuffer(own["seen"].iloc[0], np.int64)

    def hashes(raw):
        data = np.frombuffer(raw + b" ", np.uint8)
        return Hasher(data).pieces(*words(data, SPACES))

    out = [(batch, key[0], counts[np.searchsorted(names, hashes(raw))].tobytes()) for batch, raw in zip(asked["batch"], asked["words"])]
    return pd.DataFrame(out, columns=["batch", "group", "seen"])


def _add_answers(every: np.ndarray, owner: np.ndarray, logs: np.ndarray, rows: int) -> np.ndarray:
    """Sum of each text's answers, which stand in the order of the distinct keys: keys are sorted with their texts and walked once."""
    every = every << np.uint64(16) | owner.astype(np.uint64)
    every.sort()
    scores, at = np.zeros(rows), -1
    for a in range(0, len(every), PIECE):
        some = every[a : a + PIECE]
        before = every[a - 1 : a] if a else ~some[:1]
        place = at + np.cumsum(some >> np.uint64(16) != np.concatenate([before, some[:-1]]) >> np.uint64(16))
        at = place[-1]
        scores += np.bincount((some & np.uint64(65535)).astype(np.int64), weights=logs[place], minlength=rows)
    return scores


def score(docs: DataFrame, folds: int = 7, apart: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Learns from all rows whose crc32 of the id as text is not ``apart`` modulo ``folds``. A text is its words, A-Z in lower
    case, and an end. Its score is the log10 probability of its bytes, words with one space between them and an end mark:
    each bit of a byte is predicted from the bits before it and up to DEPTH bytes of the text before it, across words, and
    context-tree weighting mixes the Krichevsky-Trofimov estimates of all these depths with exact posterior weights.
    base_score is the add-one estimate of the words. Also see ``code_length``.

    A batch of texts counts its distinct contexts and sends them to stems, by the two latest bytes. Counts of a stem are
    added up FAN_IN batches at a time, so what one task gathers is bounded by the distinct contexts of a stem; then trees
    are built. The same keys ask: questions of a stem are split into tasks of ANSWER_BYTES, each with the stem's tree, and
    answers return to the batches. Only depths 0 and 1 of the trees, of fixed size, pass through the driver. Words are
    counted likewise, by groups.
    A null or empty text is an end alone. A row without an id counts as learnt from. Repeated rows teach once each and
    score alike. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    room = Workspace(spark, "ctw")
    groups = parts(spark)
    stored = room.save(_batched(docs, groups, folds, apart), "batches")
    requests = stored.select("batch", F.posexplode(F.arrays_zip("words", "seen")).alias("group", "both")).select(
        "batch", "group", F.col("both.words").alias("words"), F.col("both.seen").alias("seen")).where(F.octet_length("words") > 0)
    lists = room.save(requests.groupBy("group").applyInPandas(
        _vocabulary, "group int, known long, total long, hashes binary, seen binary"), "vocabulary")

    def ends(frames):
        for frame in frames:
            yield pd.DataFrame({"n": [sum(len(x) - int(np.frombuffer(x, np.uint8).sum()) for x in frame["held"])]})

    known, total = lists.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).collect()[0]
    texts = stored.select("held").mapInPandas(ends, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    train_tokens, distinct = total + texts, known + (texts > 0)

    left = -(-stored.select("batch").count() // FAN_IN)
    asked = stored.select("batch", F.inline("stems"))
    counted = asked.select("stem", F.pmod(F.xxhash64("batch"), F.lit(max(left, 1))).alias("part"), "keys", F.lit(4).alias("width"), "n")
    while left > 1:
        merged = counted.groupBy("stem", "part").applyInPandas(_merged, "stem int, part long, keys binary, width int, n binary")
        left = -(-left // FAN_IN)
        counted = room.save(merged.withColumn("part", F.col("part") % left), "merged")
    trees = room.save(counted.groupBy("stem").applyInPandas(
        _subtree, "stem int, latest int, keys binary, n binary, up binary"), "trees")
    zeros, ones, whole = (np.zeros((256, 256)) for _ in range(3))
    for r in trees.select("latest", "up").groupBy("latest").applyInPandas(_latest, "latest int, up binary").toLocalIterator():
        zeros[r["latest"]], ones[r["latest"]], whole[r["latest"]] = np.frombuffer(r["up"], np.float64).reshape(3, 256)
    held = spark.sparkContext.broadcast(Upper(zeros, ones, whole))
    shares = asked.groupBy("stem").agg(F.ceil(F.sum(F.octet_length("keys")) / ANSWER_BYTES).cast("int").alias("shares"))
    shares = room.save(shares, "shares")
    questions = asked.select("stem", "batch", "keys").join(shares, "stem").select(
        "stem", F.pmod(F.xxhash64("batch"), F.col("shares")).cast("int").alias("share"), "batch", "keys")
    served = trees.select("stem", "keys", "n").join(shares, "stem").select(
        "stem", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "keys", "n")
    answers = served.groupBy("stem", "share").cogroup(questions.groupBy("stem", "share")).applyInPandas(
        _answers(held), "batch long, stem int, logs binary")
    seen = lists.select("group", "hashes", "seen").groupBy("group").cogroup(requests.select("group", "batch", "words").groupBy("group")) \
        .applyInPandas(_word_counts, "batch long, group int, seen binary")
    back = seen.select("batch", "group", "seen", F.lit(None).cast("binary").alias("logs")).unionByName(
        answers.select("batch", F.col("stem").alias("group"), F.lit(None).cast("binary").alias("seen"), "logs"))

    def sums(key, batch: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        row = batch.iloc[0]
        counts, logs = (found[found[c].notna()].sort_values("group")[c] for c in ("seen", "logs"))
        counts = np.frombuffer(b"".join(counts), np.int64)
        logs = np.frombuffer(b"".join(logs), np.float32)
        lengths = np.frombuffer(row["lengths"], "<i8")
        data = np.frombuffer(pa.decompress(row["data"], decompressed_size=int(row["size"]), codec="zstd", asbytes=True), np.uint8)
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        begins = np.cumsum(lengths) - lengths
        starts, stops = words(data, SPACES)
        _, tokens, _ = _own_words(data, starts, stops, groups)
        floor = train_tokens + distinct + 1
        mine = owner[starts]

        def base(c):
            return np.log10((c + 1) / floor)

        def add(values):
            return np.bincount(mine, weights=values[tokens], minlength=len(lengths))

        scores = _add_answers(byte_keys(data, begins, owner), owner, logs, len(lengths))
        release()
        return pd.DataFrame({
            "doc_id": pd.array(list(row["ids"]), "Int64"), "held_out": np.frombuffer(row["held"], np.uint8).astype(bool),
            "n_tokens": np.bincount(mine, minlength=len(lengths)) + 1, "n_known": (add(counts > 0) + (texts > 0)).astype(np.int64),
            "train_tokens": train_tokens, "base_score": add(base(counts)) + base(texts), "score": scores})

    return stored.select("batch", "ids", "held", "lengths", "size", "data").groupBy("batch").cogroup(back.groupBy("batch")).applyInPandas(
        sums, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def code_length(docs: DataFrame, **options) -> DataFrame:
    """doc_id and bits_per_byte, the code length of a text by the model over its length in bytes; null for an empty text."""
    size = docs.select(F.col("doc_id").alias("id"), F.octet_length(F.col("text").cast("string")).alias("bytes"))
    return score(docs, **options).join(size, F.col("doc_id").eqNullSafe(F.col("id"))).select(
        "doc_id", F.when(F.col("bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte"))
