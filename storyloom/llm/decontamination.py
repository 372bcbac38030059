"""Benchmark decontamination with a positional inverted index, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.session import Workspace

from .tables import lower_ascii

#: What separates words, once A-Z are in lower case.
MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables of at most so many rows (terms or windows, each of bounded size) are broadcast; larger ones are shuffled.
SMALL = 200_000


def words_of(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), MARKS), "")


def windows(items: DataFrame, n: int) -> DataFrame:
    """item_id, words: every n following words of an item, or all of them if it has fewer; none if it has no word."""
    each = items.select("item_id", words_of(F.col("text")).alias("all"))
    last = F.greatest(F.size("all") - n + 1, F.lit(1))
    return each.where(F.size("all") > 0).select("item_id", "all", F.explode(F.sequence(F.lit(1), last)).alias("at")) \
        .select("item_id", F.slice("all", F.col("at"), n).alias("words")).distinct()


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint if the table is counted and found small, else none: then Spark shuffles."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _row() -> Column:
    """Tells rows apart by id and text, so that rows without an id, or that share one, get their own hits."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                    F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))


class Index:
    """Positional postings of the terms that can start a search, stored in the shared folder.

    A posting has term, row, pos and ``near``, the words up to ``reach`` before and behind it: with these the lists of
    the further terms of a query are intersected where the first term's posting lies, offset by offset, with no join.
    Terms are looked up in their order of corpus frequency, so a window starts from its rarest term.
    """

    def __init__(self, docs: DataFrame, queries: DataFrame, reach: int):
        """queries: a column ``words``. Frequencies are counted over all documents, for the terms of the queries."""
        self.room = Workspace(docs.sparkSession, "decontamination")
        self.reach = reach
        texts = docs.select(_row().alias("row"), words_of(F.col("text")).alias("all"))
        asked = queries.select("words").distinct()
        terms = self.room.save(asked.select(F.explode("words").alias("term")).distinct(), "terms")
        seen = texts.select(F.explode_outer("all").alias("term")).join(_small(terms), "term")
        self.frequency = self.room.save(seen.groupBy("term").count(), "frequency")
        ranked = asked.select(F.sha2(F.concat_ws(" ", "words"), 256).alias("window"), "words",
                              F.posexplode("words").alias("offset", "term")) \
            .join(_small(self.frequency), "term", "left").groupBy("window").agg(
                F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "term", "offset")).alias("rarest"),
                F.first("words").alias("words"))
        self.windows = self.room.save(
            ranked.where("rarest.n > 0").select("window", "words", F.size("words").alias("n"),
                                                F.col("rarest.term").alias("term"), F.col("rarest.offset").alias("offset")),
            "windows")
        starts = self.room.save(self.windows.select("term").distinct(), "starts")
        lists = texts.select("row", "all", F.posexplode_outer("all").alias("pos", "term")).join(_small(starts), "term")
        first = F.greatest(F.col("pos") - reach, F.lit(0))
        self.postings = self.room.save(
            lists.select("term", "row", "pos", first.alias("first"),
                         F.slice("all", first + 1, F.lit(2 * reach + 1)).alias("near")), "postings")

    def phrases(self) -> DataFrame:
        """row, window, start, n: every place of a document where the words of a window follow each other."""
        start = F.col("pos") - F.col("offset")
        found = F.slice("near", start - F.col("first") + 1, F.col("n"))
        return self.postings.join(_small(self.windows), "term") \
            .where((start >= F.col("first")) & (F.when(start >= F.col("first"), found) == F.col("words"))) \
            .select("row", "window", start.alias("start"), "n")

    def proximity(self, slack: int = 3) -> DataFrame:
        """row, window, pos, n: places of a window's rarest term where all its n words, each as often as in the window and in
        any order, lie within n - 1 + slack words before and behind. The index must reach as far, else ValueError."""
        if self.windows.where(F.col("n") - 1 + slack > self.reach).limit(1).count():
            raise ValueError("slack passes the reach of the index")
        away = F.col("n") - 1 + slack
        low = F.greatest(F.col("pos") - away - F.col("first"), F.lit(0))
        around = F.slice("near", low + 1, F.col("pos") + away - F.col("first") - low + 1)
        near = self.postings.join(_small(self.windows), "term").select("row", "window", "pos", "n", "words", around.alias("around")) \
            .where(F.size(F.array_except("words", "around")) == 0)
        # removing a word from both arrays tells how often it stands in each
        often = lambda a, w: F.size(a) - F.size(F.array_remove(a, w))
        enough = F.forall(F.array_distinct("words"), lambda w: often(F.col("around"), w) >= often(F.col("words"), w))
        return near.where(enough).select("row", "window", "pos", "n")


def find(docs: DataFrame, items: DataFrame, n: int = 10, slack: int = 0) -> tuple[Index, DataFrame, DataFrame]:
    """The index, the windows of the items (window, item_id) and the exact hits (row, window, start, n), stored."""
    own = windows(items, n)
    index = Index(docs, own, n - 1 + slack)
    hits = index.room.save(index.phrases().distinct(), "hits")
    return index, own.select(F.sha2(F.concat_ws(" ", "words"), 256).alias("window"), "item_id"), hits


def _items(places: DataFrame, members: DataFrame) -> DataFrame:
    """row, item: the items with a window among the places."""
    return places.select("row", "window").distinct().join(_small(members), "window") \
        .select("row", F.col("item_id").cast("string").alias("item")).distinct()


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, slack: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    A word is hit if it lies in an occurrence of a window, n following words of an item or a whole shorter item. With
    ``slack``, n_near counts as well the items of which a window's words all stand, in any order and with up to that many
    words more, around the window's rarest word. A null, empty or wordless text has no words and no hits, a null or wordless
    item has no windows; empty tables give no hits. Every row is judged by its own text, also where rows share an id or have
    none; repeated rows get equal results. Windows that several items share count for each of them. Other columns are not read.
    """
    index, members, hits = find(docs, items, n, slack or 0)
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    spans = hits.groupBy("row", "start").agg(F.max("n").alias("n")) \
        .withColumn("done", F.coalesce(F.max(end).over(before), F.lit(0)))
    found = spans.groupBy("row").agg(F.sum(F.greatest(end - F.greatest("start", "done"), F.lit(0))).alias("n_hit"))
    named = _items(hits, members).groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = found.join(named, "row")
    if slack is not None:
        close = _items(index.proximity(slack), members).groupBy("row").agg(F.count(F.lit(1)).alias("n_near"))
        found = found.join(close, "row", "full")
    found = index.room.save(found.withColumnRenamed("row", "hit_row"), "found")
    index.room.keep(found)
    rows = docs.select("doc_id", "text")
    rows = rows.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"), _row().alias("row"))
    more = [F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")] if slack is not None else []
    return rows.join(_small(found), F.col("row") == F.col("hit_row"), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"), *more)


def clean(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The rows of docs, all columns, in which no window of n words of an item occurs.

    Items shorter than n words are searched whole, as above; every row is judged by its own text.
    """
    index, _, hits = find(docs, items, n)
    bad = index.room.save(hits.select(F.col("row").alias("hit_row")).distinct(), "bad")
    index.room.keep(bad)
    return docs.join(_small(bad), _row() == bad["hit_row"], "left_anti")
