"""Source independence, publish eligibility and numeric conflicts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions.facts import numeric_facts, rel_diff
from storyloom.functions.labels import provenance, publisher_entity
from storyloom.functions.text import strip, text_or_empty
from storyloom.operators.clustering import source_groups


def valid_sources(citations: DataFrame) -> DataFrame:
    """Citations whose publisher is resolved."""
    return citations.filter(~publisher_entity(F.col("name"), F.col("url")).isin(K.UNRESOLVED_ENTITIES))


def distinct_valid_sources(citations: DataFrame, key: str = "card_id") -> DataFrame:
    """One row per cluster and resolved publisher, excluded tiers removed."""
    return (
        valid_sources(citations)
        .filter(~F.lower(strip(text_or_empty(F.col("trust_tier")))).isin("3", "unresolved", "unknown"))
        .select(key, publisher_entity(F.col("name"), F.col("url")).alias("entity"))
        .distinct()
    )


def source_facts(citations: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Counts that eligibility and verification type are decided on."""
    tier = F.lower(strip(text_or_empty(F.col("trust_tier"))))
    official = tier.isin("official_local", "official") & F.coalesce(F.col("verified_local_source"), F.lit(False))
    valid = ~publisher_entity(F.col("name"), F.col("url")).isin(K.UNRESOLVED_ENTITIES)
    return citations.groupBy(key).agg(
        F.count(F.lit(1)).alias("source_count"),
        F.count_if(official).alias("official_local"),
        F.count_if(valid).alias("valid_sources"),
        F.bool_or(valid & tier.isin("1", "2", "2.0")).alias("has_trusted"),
    )


def independent_counts(citations: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Number of independent source groups per cluster; ``texts`` as in ``source_groups``."""
    groups = source_groups(citations, texts=texts)
    return groups.groupBy("cluster_id").agg(F.count_distinct("group_ord").alias("independent_groups"))


def is_local(scope: Column) -> Column:
    return F.lower(strip(text_or_empty(scope))).isin("district", "local")


def eligible(scope) -> Column:
    """Publishable: one official local source, or two groups with a trusted one."""
    return (is_local(scope) & (F.col("official_local") >= 1)) | (
        (F.col("valid_sources") >= 2)
        & (F.coalesce("independent_groups", F.lit(0)) >= 2)
        & F.coalesce("has_trusted", F.lit(False))
    )


def verification_type(scope, conflict) -> Column:
    return (
        F.when(conflict, F.lit("flagged_conflict"))
        .when(is_local(scope) & (F.col("official_local") == 1) & (F.col("source_count") == 1),
              F.lit("official_source"))
        .when(F.coalesce("independent_groups", F.lit(0)) < 2, F.lit("single_source"))
        .otherwise(F.lit("cross_verified"))
    )


def numeric_conflicts(articles: DataFrame, key: str = "cluster_id", threshold: float = 0.20) -> DataFrame:
    """(cluster, label, low, high) where the numbers given for a label differ too much."""
    text = F.concat_ws(" ", text_or_empty(F.col("title")), text_or_empty(F.col("raw_text")))
    facts = articles.select(key, F.explode(numeric_facts(text)).alias("f")).select(key, "f.label", "f.value")
    ranges = facts.groupBy(key, "label").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n")
    )
    return ranges.filter((F.col("n") >= 2) & (rel_diff(F.col("low"), F.col("high")) > threshold)).select(
        key, "label", "low", "high", F.concat(F.lit("Reports differ on "), "label").alias("note")
    )


def conflict_notes(articles: DataFrame, key: str = "cluster_id", threshold: float = 0.20) -> DataFrame:
    """Sorted notes per cluster; one note per label, so their number is bounded by the vocabulary."""
    return numeric_conflicts(articles, key, threshold).groupBy(key).agg(
        F.array_sort(F.collect_list("note")).alias("conflict_notes")
    )


def evaluate_clusters(citations: DataFrame, articles: DataFrame, scopes: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Eligibility, conflict flag and verification type per cluster.

    ``scopes`` gives cluster_id and scope (the category of the lead article);
    ``texts`` is as in ``source_groups``.
    """
    facts = source_facts(citations).join(independent_counts(citations, texts), "cluster_id", "left")
    notes = conflict_notes(articles)
    joined = facts.join(scopes, "cluster_id", "left").join(notes, "cluster_id", "left")
    flagged = F.col("conflict_notes").isNotNull()
    return joined.select(
        "cluster_id", "source_count", "valid_sources",
        F.coalesce("independent_groups", F.lit(0)).alias("independent_groups"),
        eligible(F.col("scope")).alias("eligible"),
        flagged.alias("flagged_conflict"),
        F.coalesce("conflict_notes", F.array().cast("array<string>")).alias("conflict_notes"),
        verification_type(F.col("scope"), flagged).alias("verification_type"),
    )


def source_pairs(citations: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Dependence of each citation on the first one of its publisher group.

    Pairs inside a cluster are never listed: each citation is paired with its
    group leader.
    """
    return source_groups(citations, texts=texts).filter("ord <> group_ord")


def corroboration(citations: DataFrame, key: str = "card_id") -> DataFrame:
    """Distinct resolved publisher names per card, and the single-source guard."""
    name = F.lower(strip(text_or_empty(F.col("name"))))
    usable = (
        provenance(F.col("source_id"), F.col("name"), F.col("url"), F.col("trust_tier")) != "unresolved"
    ) & (name != "")
    per_card = citations.groupBy(key).agg(
        F.count_distinct(F.when(usable, name)).alias("names"), F.count(F.lit(1)).alias("n_sources")
    )
    count = F.when(F.col("names") > 0, F.col("names")).otherwise(F.col("n_sources"))
    return per_card.select(
        key, "n_sources", count.alias("corroboration_count"), (count <= 1).alias("is_single_source")
    )


def guarded_type(raw_type, is_single, n_sources) -> Column:
    """A single-source card is never described as cross-verified."""
    single = F.when(raw_type == "official_source", F.lit("official_source")).otherwise(F.lit("single_source"))
    return F.when(is_single | (n_sources <= 1), single).otherwise(F.coalesce(raw_type, F.lit("multi_source")))
