"""Line dedup by a segment-partition edit join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.session import Workspace

#: Edits that near lines may differ by, and characters from which lines are compared so; shorter ones must be equal.
EDITS, LEAST = 2, 24
#: Tables of at most so many rows of fixed size are broadcast, of single numbers five times as many; larger ones are shuffled.
SMALL = 200_000
#: Letters whose counts tell most far pairs apart before their texts are fetched, eight to a packed column.
LETTERS = ("etaoinsr", "hlducmfp", "gwybvkxz")

_LAST = (1 << 63) - 1


def _small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def _segments(edits: int) -> Column:
    """own, less, i, move of all substrings that can be a segment of a line at most ``edits`` shorter.

    A line of n characters is cut into edits + 1 segments, the last n mod (edits + 1) of them one longer. Within ``edits`` edits
    at least one segment is left whole; segment i has then moved by no more than i, and by no more than what is left
    of the edits behind it. Own ones are those of the line itself.
    """
    return F.array(*(F.struct(F.lit(less == move == 0).alias("own"), F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(move).alias("move"))
                     for less in range(edits + 1) for i in range(edits + 1)
                     for move in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1)))


def _probes(lines: DataFrame, edits: int, *keep: str) -> DataFrame:
    """``keep``, key and own of all substrings of ``_segments``. A key has the segment's number, the length of the shorter line, and the
    substring.

    Segments are rows of a constant table and the key is one expression over its columns: keys written out one by one would make a method
    too long for the JVM to compile.
    """
    rows = lines.select(*keep, "line", "size", F.inline(_segments(edits)))
    n = F.col("size") - F.col("less")
    rows = rows.withColumn("n", n).withColumn("base", F.floor(n / (edits + 1)).cast("int"))
    longer = F.col("n") - F.col("base") * (edits + 1) - (edits + 1) + F.col("i")  # segments before i that are longer, if above 0
    width = F.col("base") + F.when(longer >= 0, 1).otherwise(0)
    rows = rows.withColumn("width", width).withColumn("at", F.col("base") * F.col("i") + F.greatest(longer, F.lit(0)) + F.col("move"))
    # of ASCII alone the bytes are cut, which hash as the characters and need not be counted from the line's start
    key = F.when(F.octet_length("line") == F.col("size"), F.xxhash64("i", "n", F.substring(F.col("line").cast("binary"), F.col("at") + 1, F.col("width")))) \
        .otherwise(F.xxhash64("i", "n", F.col("line").substr(F.col("at") + 1, F.col("width"))))
    return rows.where((F.col("at") >= 0) & (F.col("at") + F.col("width") <= F.col("size"))).select(*keep, key.alias("key"), "own")


def _occurrences(docs: DataFrame) -> DataFrame:
    """doc, digest (of the text), no, line, a, b (128 bits that stand for the line) of every line that is not blank."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("digest"),
                       F.posexplode_outer(F.split(text, "\n")).alias("no", "line"))
    return rows.where(F.trim("line") != "").select("doc", "digest", "no", "line", F.xxhash64("line").alias("a"),
                                                   F.xxhash64(F.lit(7), "line", F.lit(11)).alias("b"))


def _bags(line: Column) -> list[Column]:
    """Counts of LETTERS in a line, each up to 255, packed by eight."""
    out = []
    for letters in LETTERS:
        packed = F.lit(0).cast("long")
        for k, x in enumerate(letters):
            n = F.least(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(x), F.lit(""))), F.lit(255)).cast("long")
            packed = packed.bitwiseOR(F.shiftleft(n, 8 * k))
        out.append(packed)
    return out


def _apart(x: str, y: str) -> Column:
    """Sum of the differences of two lines' packed counts; an edit changes it by 2 at most."""
    total = F.lit(0).cast("long")
    for i in range(len(LETTERS)):
        for k in range(8):
            a, b = (F.shiftrightunsigned(F.col(f"{c}.bag{i}"), 8 * k).bitwiseAND(255) for c in (x, y))
            total = total + F.abs(a - b)
    return total


def near_earlier(lines: DataFrame, firsts: DataFrame, room: Workspace, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """a, b of the lines that have another line within ``edits`` edits whose first place is earlier.

    First the keys that different lines share are found by an aggregation that only keeps two hashes a key; keys are made again for the
    join with these rather than kept on disk. Then, of the lines with such keys, the earliest of each key is compared with all others; lines still without an earlier neighbour meet
    every earlier line of their keys whose letter counts allow it. So a key that very many lines share costs one comparison a line
    as long as they are near, and lines that share a segment but not their letters are not paired.
    """
    long = lines.withColumn("size", F.char_length("line")).where(F.col("size") >= least)
    keyed = _probes(long, edits, "a")
    live = room.save(keyed.groupBy("key").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low <> high").select("key"), "live")
    # always by a merge, so that what is shuffled grows with the lines and not from the size on at which live can't be broadcast
    members = room.save(keyed.join(live.hint("merge"), "key").distinct(), "members")
    wanted = room.save(members.select("a").distinct(), "wanted")
    texts = room.save(long.join(_small(wanted, 5 * SMALL), "a", "left_semi").select("a", "b", "line").distinct(), "texts")
    bags = texts.select("a", "b", *(c.alias(f"bag{i}") for i, c in enumerate(_bags(F.col("line")))))
    whole = room.save(firsts.join(bags, ["a", "b"]), "whole")
    placed = room.save(members.join(whole, "a").select(
        "key", "own", F.struct("doc", "no", "a", "b", *(f"bag{i}" for i in range(len(LETTERS)))).alias("at")), "placed")

    def verified(pairs: DataFrame) -> DataFrame:
        """a, b of the later line of each pair (early, late) that is near enough."""
        pairs = pairs.select("early", "late").distinct()
        one = texts.select(F.col("a").alias("ea"), F.col("b").alias("eb"), F.col("line").alias("early_line"))
        two = texts.select(F.col("a").alias("la"), F.col("b").alias("lb"), F.col("line").alias("late_line"))
        pairs = pairs.join(two, (F.col("late.a") == F.col("la")) & (F.col("late.b") == F.col("lb"))) \
            .join(one, (F.col("early.a") == F.col("ea")) & (F.col("early.b") == F.col("eb")))
        return pairs.where(F.levenshtein("early_line", "late_line", edits) >= 0) \
            .select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()

    hubs = placed.groupBy("key").agg(F.min("at").alias("early"))
    first = room.save(verified(placed.join(hubs, "key").where("at.a <> early.a or at.b <> early.b")
                               .select("early", F.col("at").alias("late"))), "first")
    gone = first.select(F.col("a").alias("ga"), F.col("b").alias("gb"))
    open_ = placed.join(gone, (F.col("at.a") == F.col("ga")) & (F.col("at.b") == F.col("gb")), "left_anti") \
        .select("key", F.col("own").alias("late_own"), F.col("at").alias("late"))
    again = placed.select("key", F.col("own").alias("early_own"), F.col("at").alias("early")).join(open_, "key") \
        .where((F.col("early") < F.col("late")) & (F.col("early_own") | F.col("late_own"))) \
        .where(_apart("early", "late") <= 2 * edits)
    return first.unionByName(room.save(verified(again), "second")).distinct()


def repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """doc, digest and the numbers (from 0) of the lines to drop, for every text that has one; ``dedup_lines`` has the rule."""
    room = Workspace(docs.sparkSession, "linededup")
    lines = _occurrences(docs)
    seen = lines.groupBy("a", "b").agg(F.min(F.struct("doc", "no")).alias("first"), F.max(F.struct("doc", "no")).alias("last"))
    firsts = room.save(seen.select("a", "b", "first.doc", "first.no", (F.col("first") < F.col("last")).alias("again")), "firsts")
    near = near_earlier(lines.select("a", "b", "line"), firsts.drop("again"), room, edits, least)
    judged = firsts.join(near.withColumn("near", F.lit(True)), ["a", "b"], "left") \
        .where(F.col("again") | F.col("near")).select("a", "b", F.struct("doc", "no").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    judged = room.save(judged, "judged")
    dropped = lines.select("doc", "digest", "no", "a", "b").join(_small(judged), ["a", "b"]) \
        .where(F.col("near") | (F.struct("doc", "no") > F.col("first")))
    numbers = room.save(dropped.groupBy("doc", "digest").agg(F.collect_set("no").alias("numbers")), "numbers")
    room.keep(numbers)
    return numbers


def _weight(numbers: DataFrame) -> int:
    return numbers.agg(F.coalesce(F.sum(F.size("numbers") + 8), F.lit(0))).collect()[0][0]


def _alike(docs: DataFrame, numbers: DataFrame) -> DataFrame:
    """``numbers`` with every copy of a text cut as its first row is; copies are found by 128 bits of their texts.

    A copy's lines all stand later than its first row's, so they change nothing for other texts.
    """
    room = Workspace(docs.sparkSession, "alike")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("digest"),
                        F.xxhash64(F.lit(7), text, F.lit(11)).alias("more"))
    copied = texts.groupBy("digest", "more").agg(F.min("doc").alias("head"), F.max("doc").alias("last")).where("head < last")
    first = numbers.select(F.col("doc").alias("head"), "digest", "numbers")
    copied = room.save(copied.drop("last").join(first, ["head", "digest"], "left"), "copied")
    held = F.broadcast(copied) if copied.count() <= SMALL and _weight(copied) <= 5 * SMALL else copied
    later = room.save(texts.join(held, ["digest", "more"]).where("doc > head").select("doc", "digest", "numbers").distinct(), "later")
    own = numbers.join(_small(later.select("doc", "digest")), ["doc", "digest"], "left_anti")
    out = room.save(own.unionByName(later.where("numbers is not null")), "numbers")
    room.keep(out)
    return out


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST,
                names: tuple[str, str] = ("line_count", "line_drops"), copies: bool = False) -> DataFrame:
    """The rows of docs, all columns in order, with the text cut to its kept lines, and behind them the numbers of lines
    and of dropped lines, called as ``names`` says.

    A line goes if an equal line has an earlier place (smaller doc_id, then smaller line number), or if it has ``least`` or more
    characters and so has another line within ``edits`` edits (insertions, deletions, exchanged characters), whether or not that one
    stays: lines are judged on the input. Blank lines stay. With ``copies``, rows whose whole
    text has an earlier row lose the lines that the first such row loses and no others, so they stay copies of it.
    A null text stays null and has no lines; an empty one has one, blank. Rows of one doc_id stand at one place: their lines are no
    repeats of each other at equal numbers; a row without an id comes last. Empty tables give empty results. If docs has columns of the two
    names, docs' own are left out; give other names then.
    """
    numbers = repeated_lines(docs, edits, least)
    if copies:
        numbers = _alike(docs, numbers)
    text = F.col("text").cast("string")
    own = [c for c in docs.columns if c not in names]
    left = docs.select(*own)
    # names that docs can't have
    free = "_" * (1 + max(map(len, own)))
    doc, digest, drops, count = (free + x for x in ("doc", "digest", "drops", "count"))
    # by a merge at all sizes: texts are shuffled once, as often as the lines' keys
    held = numbers.select(F.col("doc").alias(doc), F.col("digest").alias(digest), F.col("numbers").alias(drops)).hint("merge")
    rows = left.join(held, (F.coalesce(left["doc_id"].cast("long"), F.lit(_LAST)) == F.col(doc))
                     & (F.xxhash64(F.coalesce(left["text"].cast("string"), F.lit(""))) == F.col(digest)), "left")
    lines = F.split(text, "\n")
    gone = F.coalesce(F.size(drops), F.lit(0))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(drops), i)), "\n")
    return rows.withColumn(count, gone).select(
        *(F.when(F.col(count) > 0, kept).otherwise(text).alias("text") if c == "text" else F.col(c) for c in own),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias(names[0]),
        F.col(count).cast("long").alias(names[1]))
