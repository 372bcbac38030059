"""Joins between articles, cards, sources and readers; set operations; state changes."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions.keywords import words
from storyloom.functions.text import text_or_empty


def with_sources(cards: DataFrame, citations: DataFrame, key: str = "card_id") -> DataFrame:
    """Cards with their citations nested in order (a card has few)."""
    fields = [c for c in ("ord", "source_id", "name", "url", "trust_tier") if c in citations.columns]
    nested = citations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("sources"))
    return cards.join(nested, key, "left").withColumn(
        "sources", F.coalesce("sources", F.array().cast(nested.schema["sources"].dataType)))


def with_prefs(users: DataFrame, prefs: DataFrame) -> DataFrame:
    joined = users.join(prefs.select("device_id", "category_order"), "device_id", "left")
    return joined.withColumn("category_order", F.coalesce("category_order", F.array().cast("array<string>")))


def fk_clean(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose parent exists."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


def fk_null(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """All children, the key cleared where its parent is missing."""
    known = parent.select(F.col(parent_key).alias("_known")).distinct()
    return child.join(known, child[key] == known["_known"], "left").withColumn(key, F.col("_known")).drop("_known")


def not_in(df: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows whose key the target does not hold yet (NULL keys stay)."""
    return df.join(target.select(key).distinct(), key, "left_anti")


def repair_source(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Unknown source ids are looked up by name, else get the sentinel and tier 3."""
    ids = sources.select(F.col("source_id").alias("_id")).distinct()
    by_name = sources.filter(F.col("source_id") != K.SENTINEL_SOURCE_ID).groupBy(F.col("name").alias("_name")).agg(
        F.max("source_id").alias("_by_name"))
    joined = citations.join(ids, citations.source_id == ids["_id"], "left").join(
        by_name, citations.name == by_name["_name"], "left")
    outcome = (
        F.when(F.col("_id").isNotNull(), "kept").when(F.col("_by_name").isNotNull(), "matched_by_name")
        .otherwise("unresolved")
    )
    return (
        joined.withColumn("outcome", outcome)
        .withColumn("source_id", F.coalesce("_id", "_by_name", F.lit(K.SENTINEL_SOURCE_ID)))
        .withColumn("trust_tier", F.when(F.col("outcome") == "unresolved", "3")
                    .otherwise(F.coalesce("trust_tier", F.lit("3"))))
        .drop("_id", "_name", "_by_name")
    )


def gazetteer_entries() -> dict[str, list[str]]:
    """State to keywords: its own name and the places listed for it, states in the order of the list."""
    lines = (line.split(":", 1) for line in K.PLACES.strip().splitlines())
    return {state: [state.lower(), *(p.strip() for p in places.split(",") if p.strip())] for state, places in lines}


def gazetteer_rows(spark, entries: dict[str, list[str]] | None = None) -> DataFrame:
    """Gazetteer table (state, keyword, ord), by default of all states and their places."""
    rows = [(state, kw, i) for i, (state, kws) in enumerate((entries or gazetteer_entries()).items()) for kw in kws]
    return spark.createDataFrame(rows, "state string, keyword string, ord int")


# Delimiters that may stand before and after a keyword, white space aside.
_BEFORE, _AFTER = ",.-:'\"([{", ",.-:'\")!]}"
_BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BETWEEN = _BLANK + r",.\-:'\"(\[{)!\]}"
# Keywords up to which a gazetteer goes to where the texts are; a larger one is joined by Spark's choice.
_SMALL_GAZETTEER = 20_000


def detect_states(df: DataFrame, gazetteer: DataFrame, key: str, text) -> DataFrame:
    """(key, detected_state): the first gazetteer state with a delimited keyword in the text.

    A text is cut into words between delimiters. Of every place, the runs of up to as many words as the longest keyword
    has, single-spaced and rightly delimited on both sides, meet the gazetteer in one equi-join; what leaves a text is a
    key and a run, never the text. A gazetteer is counted first: to a small one no run is shuffled, and only runs that begin as
    one of its keywords of that length are made at all. A null text has no state.
    """
    names = gazetteer.filter("keyword is not null").groupBy(F.lower("keyword").alias("keyword")).agg(
        F.min_by("state", "ord").alias("found"), F.min("ord").alias("ord"))
    begins = names.select(F.size(F.split("keyword", " ")).alias("n"), F.split_part("keyword", F.lit(" "), F.lit(1)).alias("word"))
    count, most = begins.agg(F.count(F.lit(1)), F.max("n")).collect()[0]
    small, most = count <= _SMALL_GAZETTEER, most or 1
    first = {n: [] for n in range(1, most + 1)}
    if small:
        names = F.broadcast(names)
        for row in begins.distinct().collect():
            first[row.n].append(row.word)
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    cut = rf"([^{_BETWEEN}]+)([{_BETWEEN}]+)"
    parts = df.select(
        key, F.regexp_extract_all(low, F.lit(cut), F.lit(1)).alias("_words"),
        F.concat(F.array(F.regexp_extract(low, rf"^([{_BETWEEN}]*)", 1)), F.regexp_extract_all(low, F.lit(cut), F.lit(2))).alias("_gaps"))

    def blank_or(char, others):
        return char.rlike(f"[{_BLANK}]") | F.lit(others).contains(char)

    def runs(n):
        """Runs of n words; the gap before word i is gap i."""
        inner = F.array_repeat(F.lit(" "), n - 1)
        fits = lambda i: (
            blank_or(F.substring(F.get("_gaps", i), -1, 1), _BEFORE) & blank_or(F.substring(F.get("_gaps", i + n), 1, 1), _AFTER)
            & (F.slice("_gaps", i + 2, F.lit(n - 1)) == inner))
        starts = F.when(F.size("_words") >= n, F.sequence(F.lit(0), F.size("_words") - n)).otherwise(F.array().cast("array<int>"))
        if small:
            starts = F.filter(starts, lambda i: F.get("_words", i).isin(first[n]))
        return F.transform(F.filter(starts, fits), lambda i: F.array_join(F.slice("_words", i + 1, F.lit(n)), " "))

    found = parts.select(key, F.explode(F.array_distinct(F.flatten(F.array(*[runs(n) for n in range(1, most + 1)])))).alias("keyword"))
    return found.join(names, "keyword").groupBy(key).agg(F.min_by("found", "ord").alias("detected_state"))


def merge_master(old: DataFrame, new: DataFrame, keys=("id", "canonical_url", "headline")) -> DataFrame:
    """Union of cached and fresh cards; the fresh card of a key wins."""
    tagged = old.withColumn("_fresh", F.lit(0)).unionByName(new.withColumn("_fresh", F.lit(1)), True)
    key = F.coalesce(*[F.when(text_or_empty(F.col(k).cast("string")) != "", F.col(k).cast("string")) for k in keys])
    # a total order: of equally fresh cards the last by all columns wins
    rest = [F.desc_nulls_last(c) for c, kind in sorted(tagged.dtypes) if c != "_fresh" and "map<" not in kind]
    w = Window.partitionBy("_key").orderBy(F.desc("_fresh"), *rest)
    return (
        tagged.withColumn("_key", key).filter("_key is not null")
        .withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_key", "_fresh")
    )


def compare_feeds(a: DataFrame, b: DataFrame, columns=("importance_score", "urgency_score", "freshness_score",
                                                       "verification_score")) -> DataFrame:
    """Cards of two feeds whose reader-independent scores differ."""
    left = a.select("card_id", F.struct(*columns).alias("_a"))
    right = b.select("card_id", F.struct(*columns).alias("_b"))
    return left.join(right, "card_id").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("card_id")


def union_articles(*frames: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def clusters_without_card(clusters: DataFrame, cards: DataFrame) -> DataFrame:
    return clusters.join(cards.select("cluster_id").distinct(), "cluster_id", "left_anti")


def cluster_profile(articles: DataFrame, sources: DataFrame, least: int = 1) -> DataFrame:
    """Clusters with article counts and the latest of their labels."""
    return (
        articles.join(sources.select("source_id", F.col("category").alias("source_category"), "name"), "source_id")
        .groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("articles"), F.max("source_category").alias("category"),
             F.max("name").alias("name"), F.max("title").alias("title"))
        .filter(F.col("articles") >= least)
    )


def latest_by_key(df: DataFrame, key: str, ts: str) -> DataFrame:
    """The latest row of each key."""
    rest = [c for c in df.columns if c != key]
    order = F.struct(ts, *[c for c in rest if c != ts])
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def apply_changes(state: DataFrame, changes: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """State after its changes: the last change per key updates or deletes.

    ``changes`` has the state's columns plus ``op`` (put, add, remove) and a
    time; add keeps an existing row.
    """
    columns = state.columns
    last = latest_by_key(changes, key, ts).select(key, F.struct("op", *[c for c in columns if c != key]).alias("_c"))
    old = state.select(key, F.struct(*[c for c in columns if c != key]).alias("_s"))
    both = old.join(last, key, "full_outer")
    keep_old = F.col("_c").isNull() | ((F.col("_c.op") == "add") & F.col("_s").isNotNull())
    out = both.filter(F.coalesce(F.col("_c.op") != "remove", F.lit(True)))
    return out.select(key, *[
        F.when(keep_old, F.col(f"_s.{c}")).otherwise(F.col(f"_c.{c}")).alias(c) for c in columns if c != key
    ])
