"""Near-duplicate documents by SetSketch registers: banded search, joint likelihood, check on full sets, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.session import Workspace

from .components import components
from .textblocks import SPACES, Hasher, blocks, distinct_per_row, mix, packed, per_row, shingles, words

#: Registers, and registers of a band: at a similarity of 0.8 a pair shares no band with probability 2e-6, at 0.85 with 2e-8.
REGISTERS, BAND = 96, 4
#: Base and rate of the sketch, and its largest register value.
BASE, RATE, TOP = 1.02, 20.0, 65535
#: A pair is checked on its sets unless its estimated similarity is so many standard errors below the threshold.
ERRORS = 5.5
#: Rounds in which the members of a band meet one of them, before the rest meet by rare shingles; bits of a frequency slot.
STARS, SLOTS = 3, 19
#: Ids of at most so many documents are broadcast to find their texts; with more, Spark shuffles.
SMALL = 1_000_000

_ODDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)


def registers(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of registers for each run of values; runs are not empty.

    A register is the truncated exponential rank of the least of the elements' exponential draws, so that of a union is
    the larger of the two.
    """
    out = np.empty((len(starts), REGISTERS), np.uint64)
    for i, odd in enumerate(_ODDS):
        np.minimum.reduceat(values * odd ^ (odd >> np.uint64(7)), starts, out=out[:, i])
    draws = -np.log1p(-(out.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(draws, 1e-300)) / np.log(BASE)), 0, TOP).astype(np.uint16)


def _sets(block, k: int):
    """Distinct shingles of a block, 52 bits each, ascending in each text, the text of each, and counts per text."""
    data = block.lower()
    starts, ends = words(data, SPACES)
    found, owner = shingles(Hasher(data).pieces(starts, ends), per_row(starts, block.offsets), k)
    values, owner, _ = distinct_per_row(found, owner)
    return values, np.bincount(owner, minlength=len(block))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, a hash of the set (lo, hi), the registers, and a key for each band of them."""

    def run(batches):
        for block in blocks(batches):
            values, counts = _sets(block, k)
            some = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[some]
            lo, hi = np.zeros(len(block), np.uint64), np.zeros(len(block), np.uint64)
            regs, keys = np.zeros((len(block), REGISTERS), np.uint16), np.zeros((len(block), REGISTERS // BAND), np.uint64)
            if len(some):
                once = mix(values)
                lo[some], hi[some] = np.add.reduceat(once, starts), np.add.reduceat(mix(once + np.uint64(1)), starts)
                regs[some] = registers(once, starts)
                for b in range(REGISTERS // BAND):
                    for j in range(b * BAND, (b + 1) * BAND):
                        keys[some, b] = mix(keys[some, b] * np.uint64(0x9E3779B97F4A7C15) + regs[some, j] + np.uint64(1 + b))
            flat = pa.array(keys.ravel().view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * keys.shape[1]), flat)
            yield pa.RecordBatch.from_arrays(
                [block.rows.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)),
                 packed(regs.ravel(), np.full(len(block), REGISTERS)), lists],
                names=["doc_id", "n_shingles", "lo", "hi", "registers", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, lo long, hi long, registers binary, bands array<long>")


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity of pairs of register rows with known set sizes, by joint likelihood over a grid."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = REGISTERS - up - down
    u, v = na / (na + nb), nb / (na + nb)
    best, out = np.full(len(a), -np.inf), np.zeros(len(a))

    def p(x):
        return np.maximum(-np.log(np.maximum(1 - np.maximum(x, 0) * (BASE - 1) / BASE, 1e-12)) / np.log(BASE), 1e-12)

    for j in np.linspace(0, 1, 201):
        j = np.minimum(j, np.minimum(na, nb) / np.maximum(na, nb))
        more, less = p(u - v * j), p(v - u * j)
        fit = up * np.log(more) + down * np.log(less) + same * np.log(np.maximum(1 - more - less, 1e-12))
        better = fit > best
        best, out = np.where(better, fit, best), np.where(better, j, out)
    return out


def _promising(percent: int):
    s = percent / 100
    least = s - ERRORS * np.sqrt(s * (1 - s) / REGISTERS)

    def run(frames):
        for frame in frames:
            if len(frame):
                a, b = (np.frombuffer(b"".join(frame[c]), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                good = likely(a, b, frame["na"].to_numpy(float), frame["nb"].to_numpy(float)) >= least
                yield frame.loc[good, ["a", "b"]]

    return run


def _linked(percent: int):
    def run(frames):
        for frame in frames:
            good = []
            for x, y in zip(frame["sa"], frame["sb"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield frame.loc[np.array(good, bool), ["a", "b"]]

    return run


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many sets have a shingle, by slot of its hash: an array of fixed size."""

    def run(frames):
        total = np.zeros(1 << SLOTS, np.int64)
        for frame in frames:
            for raw in frame["whole"]:
                np.add.at(total, (np.frombuffer(raw, np.uint64) & np.uint64((1 << SLOTS) - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": at, "n": total[at]})

    def pack(frames):
        for frame in frames:
            yield pd.DataFrame({"slots": [frame["slot"].to_numpy(np.int32).tobytes()], "n": [frame["n"].to_numpy(np.int32).tobytes()]})

    sums = sets.select("whole").mapInPandas(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << SLOTS, np.int32)
    for row in sums.mapInPandas(pack, "slots binary, n binary").toLocalIterator():
        out[np.frombuffer(row["slots"], np.int32)] = np.frombuffer(row["n"], np.int32)
    return out


def _prefixes(held, percent: int):
    """The rarest shingles of each set, as many as two linked sets can't both lack; ``pos`` counts from the rarest."""

    def run(frames):
        for frame in frames:
            out = []
            for doc, raw in zip(frame["doc_id"], frame["whole"]):
                x = np.frombuffer(raw, np.uint64)
                seen = held.value[(x & np.uint64((1 << SLOTS) - 1)).astype(np.int64)]
                order = np.lexsort((x, seen))[: len(x) * (100 - percent) // 100 + 1]
                out.append(pd.DataFrame({"doc_id": doc, "n": len(x), "token": x[order].view(np.int64), "pos": np.arange(len(order))}))
            yield pd.concat(out) if out else pd.DataFrame({"doc_id": [], "n": [], "token": [], "pos": []})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Two documents are linked if their sets of k-word shingles (whole texts, A-Z in lower case) have 100 * intersection >=
    percent * union; component_id is the smallest doc_id that links reach. A text of fewer than k words is one shingle; a
    null, empty or wordless text has none and is linked with nothing. Equal sets are one class from the start, held by
    their smallest id. Class holders that share a band of registers are candidates. In three rounds the members of a band
    are compared with one of them, so a large group of true copies costs one comparison a member and round. What still
    falls into several components within a band is decided by its rarest shingles: two linked sets share one of these, at places that
    their sizes bound, whatever the order of rarity; all pairs of different components that do are compared. So no link
    between components goes untested, and edits of one text, each far from the others, are not paired.
    A comparison drops pairs that sizes or the likelihood of the registers rule out, and decides the others on the full sets.
    Rows of one id are one node with the links of all their texts, and are all kept or all dropped; rows without an id are
    linked with nothing and kept. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    room = Workspace(spark, "neardup")
    drawn = room.save(sketches(docs, k), "sketches")
    usable = drawn.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = usable.groupBy("lo", "hi", "n_shingles").agg(F.min("doc_id").alias("holder"))
    member = room.save(usable.select("doc_id", "lo", "hi", "n_shingles").join(classes, ["lo", "hi", "n_shingles"])
                       .select("doc_id", "holder"), "members")
    holders = member.where("doc_id = holder").select(F.col("holder")).distinct()
    own = usable.join(holders, F.col("doc_id") == F.col("holder"), "left_semi")
    regs = room.save(own.select("doc_id", "n_shingles", "registers"), "registers")
    banded = own.select("doc_id", F.explode("bands").alias("band"))
    full = banded.groupBy("band").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
    group = room.save(banded.join(full.select("band"), "band").distinct(), "groups")
    wanted = group.select(F.col("doc_id").alias("id")).distinct()
    wanted = room.save(wanted, "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(_small(wanted), F.col("doc_id") == F.col("id"), "left_semi")

    def full_sets(batches):
        for block in blocks(batches):
            values, counts = _sets(block, k)
            yield pa.RecordBatch.from_arrays([block.rows.column("doc_id"), packed(values, counts)], names=["doc_id", "whole"])

    sets = room.save(texts.mapInArrow(full_sets, "doc_id long, whole binary").where(F.octet_length("whole") > 0), "sets")
    several = member.groupBy("doc_id").agg(F.min("holder").alias("low"), F.max("holder").alias("high")).where("low <> high")
    links = room.save(member.join(several.select("doc_id"), "doc_id").select(F.col("holder").alias("a"), F.col("doc_id").alias("b")), "links")
    label = room.save(components(links, room), "components")

    one = regs.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    two = regs.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("whole").alias("sb"))
    other = sets.select(F.col("doc_id").alias("a"), F.col("whole").alias("sa"))

    def linked(pairs: DataFrame) -> DataFrame:
        near = pairs.join(two, "b").join(one, "a").where(
            100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "na", "nb", "ra", "rb")
        near = room.save(near.mapInPandas(_promising(percent), "a long, b long").distinct(), "near")
        return near.join(right, "b").join(other, "a").select("a", "b", "sa", "sb").mapInPandas(_linked(percent), "a long, b long")

    def rooted(rows: DataFrame, label: DataFrame) -> DataFrame:
        return rows.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))

    for turn in range(STARS + 1):
        at = room.save(rooted(group, label), "rooted")
        mixed = at.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band", "low")
        left = at.join(room.save(mixed, "mixed"), "band")
        if turn == STARS:
            break
        # the first hub is the smallest id; later ones are drawn from what isn't linked with it
        drawn_by = F.col("doc_id") if not turn else F.when(F.col("root") != F.col("low"), F.xxhash64("doc_id", F.lit(turn)))
        hub = left.groupBy("band").agg(F.min_by(F.struct(F.col("doc_id").alias("hub"), F.col("root").alias("other")), drawn_by).alias("h")) \
            .select("band", "h.*").where(F.col("hub").isNotNull())
        pairs = left.select("band", "doc_id", "root").join(hub, "band").where("root <> other").groupBy("doc_id") \
            .agg(F.min("hub").alias("a")).select("a", F.col("doc_id").alias("b"))
        links = room.save(linked(pairs).unionByName(links), "links")
        label = room.save(components(links, room), "components")
    rest = room.save(left.select("doc_id").distinct(), "rest")
    rest_sets = sets.join(_small(rest), "doc_id", "left_semi")
    held = spark.sparkContext.broadcast(_frequencies(rest_sets))
    tokens = room.save(rooted(rest_sets.mapInPandas(_prefixes(held, percent), "doc_id long, n int, token long, pos int"), label), "tokens")
    shared = tokens.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    tokens = room.save(tokens.join(shared, "token"), "shared")
    a, b = (tokens.select("token", *(F.col(c).alias(f"{side}_{c}") for c in ("doc_id", "n", "pos", "root"))) for side in "ab")
    least = F.ceil(percent * (F.col("a_n") + F.col("b_n")) / (100 + percent) - 1e-9)
    pairs = a.join(b, "token").where("a_doc_id < b_doc_id and a_root <> b_root").where(
        (F.col("a_pos") <= F.col("a_n") - least) & (F.col("b_pos") <= F.col("b_n") - least)) \
        .select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b")).distinct()
    links = room.save(linked(room.save(pairs, "pairs")).unionByName(links), "links")
    label = room.save(components(links, room), "components")
    room.keep(drawn, member, label)
    root = member.join(label.withColumnRenamed("node", "holder"), "holder", "left") \
        .withColumn("holder", F.coalesce("root", "holder")).select("doc_id", "holder")
    root = root.groupBy("doc_id").agg(F.min("holder").alias("component")).withColumnRenamed("doc_id", "id")
    return drawn.join(root, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))
