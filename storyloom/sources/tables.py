"""Result tables: card upserts, feed snapshots and the table migration."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions.dates import as_of_column
from storyloom.operators.joins import fk_clean, fk_null, not_in, repair_source
from storyloom.operators.ranks import positions
from storyloom.sources.snapshots import write_version

REFRESHED = [
    "summary", "priority_score", "objective_score", "importance_score", "urgency_score", "freshness_score",
    "verification_score", "personal_relevance_score", "final_feed_score", "priority_reason", "impact_evidence",
    "verification_type",
]


def upsert_cards(existing: DataFrame, new: DataFrame, key: str = "headline") -> DataFrame:
    """Cards by headline: known ones get fresh scores, others are added. Of new rows with one headline the last by all columns counts."""
    columns = existing.columns
    fresh = [c for c in REFRESHED if c in new.columns and c in columns]
    total = F.struct(*[c for c, kind in sorted(new.dtypes) if c != key and "map<" not in kind])
    one = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), total).alias("_r")).select(key, "_r.*")
    added = one.select(
        key, F.struct(*[(F.col(c) if c in new.columns else F.lit(None).cast(existing.schema[c].dataType)).alias(c)
                        for c in columns if c != key]).alias("_n"))
    old = existing.select(key, F.struct(*[c for c in columns if c != key]).alias("_o"))
    both = old.join(added, key, "full_outer")

    def pick(c):
        if c in fresh:
            return F.when(F.col("_n").isNull(), F.col(f"_o.{c}")).otherwise(F.col(f"_n.{c}"))
        return F.when(F.col("_o").isNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}"))

    return both.select(*[F.col(key) if c == key else pick(c).alias(c) for c in columns])


def feed_snapshot(cards: DataFrame, as_of, by: str | None = None, limit: int | None = None, size: int = 500) -> DataFrame:
    """Envelope rows (status, updated_at, count, part) with the items in score order, at most ``size`` of them in a row.

    Envelopes are numbered from 0 for each ``by`` value, so a key of any size is spread over rows; with ``limit`` only the
    leading items are nested (the count stays whole). Places come from ranges of the order, not from one task per key.
    """
    key = by or "_all"
    rows = cards if by else cards.withColumn("_all", F.lit("all"))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    placed = positions(rows, [F.asc_nulls_first(key), F.desc("final_feed_score"), F.asc("card_id")], "_place")
    start = placed.groupBy(key).agg(F.min("_place").alias("_start"))
    placed = placed.join(start, placed[key].eqNullSafe(start[key])).select(placed["*"], (F.col("_place") - F.col("_start")).alias("_at"))
    if limit is not None:
        placed = placed.filter(F.col("_at") < limit)
    item = F.struct(F.col("_at").alias("o"), F.struct(*[c for c in cards.columns if c != by]).alias("item"))
    items = placed.groupBy(key, F.floor(F.col("_at") / size).alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda e: e["item"]).alias("items"))
    stamp = F.date_format(as_of_column(as_of), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return items.join(counts, items[key].eqNullSafe(counts[key])).select(
        *([items[by]] if by else []), F.lit("ok").alias("status"), stamp.alias("updated_at"), "count", "part", "items")


def write_feed_snapshot(cards: DataFrame, as_of, path: str, by: str | None = None, limit: int | None = None, size: int = 500) -> str:
    """A new version of the stored snapshot, see ``snapshots.write_version``; readers never meet half of one."""
    return write_version(feed_snapshot(cards, as_of, by, limit, size), path)


def migrate(tables: dict[str, DataFrame], target: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Reconciled rows to add to each target table, in dependency order.

    Seed cards go, children without parents go or lose the key, and citations
    are repaired by publisher name or moved to the sentinel source.
    """
    target = target or {}
    out: dict[str, DataFrame] = {}

    def fresh(name, key):
        df = tables[name]
        return not_in(df, target[name], key) if name in target else df

    def known(name, key):
        rows = out[name].select(key)
        return rows.union(target[name].select(key)) if name in target else rows

    out["sources"] = fresh("sources", "source_id")
    out["clusters"] = fresh("clusters", "cluster_id")
    arts = fk_clean(fresh("articles", "id"), known("sources", "source_id"), "source_id", "source_id")
    if "articles" in target:
        arts = not_in(arts, target["articles"], "url")
    out["articles"] = fk_null(arts, known("clusters", "cluster_id"), "cluster_id", "cluster_id")
    cards = fresh("cards", "card_id").filter(F.coalesce(F.col("created_by"), F.lit("")) != "seed")
    out["cards"] = fk_clean(cards, known("clusters", "cluster_id"), "cluster_id", "cluster_id")
    cites = fk_clean(tables["card_sources"], known("cards", "card_id"), "card_id", "card_id")
    sources = out["sources"].select("source_id", "name")
    if "sources" in target:
        sources = sources.union(target["sources"].select("source_id", "name"))
    out["card_sources"] = repair_source(cites, sources)
    if "reviews" in tables:
        out["reviews"] = fk_clean(tables["reviews"], known("cards", "card_id"), "card_id", "card_id")
    for plain, key in (("preferences", "device_id"), ("runs", "run_id")):
        if plain in tables:
            out[plain] = fresh(plain, key)
    return out


def write_migration(tables: dict[str, DataFrame], moved: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes every moved table and gives rows in, rows out and skipped per table, as one small table.

    Rows out are observed in the pass that writes, in its last stage, where a task that runs again counts once; rows in
    need no column of a table, so Parquet answers them from its footers.
    """
    spark, out = next(iter(moved.values())).sparkSession, []
    for name, df in moved.items():
        seen = Observation(name)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/{name}")
        out.append((name, tables[name].count(), seen.get.get("n", 0)))
    return spark.createDataFrame(out, "table_name string, rows_in long, rows_out long") \
        .withColumn("skipped", F.col("rows_in") - F.col("rows_out"))


SENTINEL = (K.SENTINEL_SOURCE_ID, "Legacy Unresolved Provenance", "3")
