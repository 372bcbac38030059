"""Counts, health, coverage and audit reports."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions.dates import as_of_column
from storyloom.functions.labels import has_wire_marker
from storyloom.functions.text import clean_text, strip, text_or_empty, word_count


def cluster_importance(articles: DataFrame, external_priority: str | None = None) -> DataFrame:
    """Importance and priority per cluster from sources, tiers and impact terms.

    Terms are tested per article and combined with ``bool_or``.
    """
    from storyloom.functions.keywords import impact_hits
    from storyloom.functions.labels import any_contains

    source = F.lower(clean_text("source"))
    text = F.concat_ws(" ", clean_text("title"), clean_text("summary"))
    names = [f"_hit{i}" for i in range(len(K.CRAWL_IMPACT_TERMS))]
    rows = articles.select(
        "cluster_id", F.when(F.col("source") != "", source).alias("_src"),
        any_contains(source, K.CRAWL_TIER_1).alias("_t1"),
        text.alias("_text"), *([external_priority] if external_priority else []),
    ).select("*", *[
        (impact_hits(F.col("_text"), [t]) > 0).alias(n) for t, n in zip(K.CRAWL_IMPACT_TERMS, names)
    ]).drop("_text")
    external = [F.max(external_priority).alias("_external")] if external_priority else []
    # distinct sources first, so that the final step has one row per source
    per_source = rows.groupBy("cluster_id", "_src").agg(
        F.count_if("_t1").alias("_t1"), *[F.bool_or(n).alias(n) for n in names], *external)
    grouped = per_source.groupBy("cluster_id").agg(
        F.count("_src").alias("distinct_sources"), F.sum("_t1").alias("tier1_count"),
        *[F.bool_or(n).alias(n) for n in names],
        *([F.max("_external").alias("_external")] if external_priority else []),
    )
    hits = F.lit(0)
    for n in names:
        hits = hits + F.col(n).cast("int")
    out = grouped.withColumn("keyword_hits", hits).drop(*names)
    d, t, k = F.col("distinct_sources"), F.col("tier1_count"), F.col("keyword_hits")
    priority = (
        F.lit(5) + F.when(d >= 4, 3).when(d >= 2, 2).otherwise(0)
        + F.when(t >= 2, 2).when(t == 1, 1).otherwise(0) + F.when(k >= 3, 3).when(k >= 1, 2).otherwise(0)
    )
    out = out.withColumn("priority", F.greatest(F.lit(1), F.least(F.lit(10), priority)))
    score = F.col("priority") * 10.0 + d * 6.0 + t * 4.0 + k * 8.0
    out = out.withColumn("importance_score", F.round(score, 2))
    if external_priority:
        given = F.col("_external")
        out = out.withColumn("priority", F.when(
            given.between(1, 10), F.greatest(F.col("priority"), given.cast("int"))).otherwise(F.col("priority"))
        ).drop("_external")
    return out


def chronology(articles: DataFrame, order: str, key: str = "cluster_id") -> DataFrame:
    """First report, latest independent report and the date to show.

    ``is_wire`` marks syndicated copies; those never refresh a story.
    """
    own = F.when(~F.col("is_wire"), F.col("published_at"))
    # equality is tested against one row per (cluster, date), so nothing is collected
    grouped = articles.groupBy(key).agg(
        F.min("published_at").alias("first_reported_at"), F.max(own).alias("_latest"),
        F.min_by(F.struct("published_at"), order)["published_at"].alias("_lead"),
    )
    dates = articles.filter(~F.col("is_wire")).select(key, F.col("published_at").alias("_lead")).filter(
        "_lead is not null").distinct().withColumn("_own", F.lit(True))
    lead = grouped.join(dates, [key, "_lead"], "left")
    return lead.select(
        key, "first_reported_at",
        F.coalesce("_latest", "first_reported_at").alias("latest_independent_at"),
        F.when(F.col("_own"), F.col("_lead")).otherwise(
            F.coalesce("first_reported_at", "_lead")).alias("published_at"),
    )


def wire_flag(title="title", summary="summary") -> Column:
    return has_wire_marker(F.concat_ws(" ", text_or_empty(F.col(title)), text_or_empty(F.col(summary))))


def daily_credits(runs: DataFrame, as_of=None, providers=None) -> DataFrame:
    """Requests used per provider and UTC day; today only when ``as_of`` is given."""
    used = F.greatest(F.lit(0).cast("bigint"), F.coalesce(F.col("credits_used"), F.lit(0)).cast("bigint"))
    out = runs if providers is None else runs.filter(F.col("provider").isin(list(providers)))
    if as_of is not None:
        out = out.filter(F.col("timestamp") >= F.date_trunc("day", as_of_column(as_of)))
    return out.groupBy(F.to_date("timestamp").alias("day"), "provider").agg(F.sum(used).alias("credits"))


def remaining_credits(daily: DataFrame, budgets: dict | None = None) -> DataFrame:
    """What is left of each provider's daily budget."""
    from storyloom.functions.labels import literal_map

    limit = F.try_element_at(literal_map(budgets or K.DAILY_BUDGETS), F.col("provider"))
    return daily.withColumn("remaining", F.greatest(F.lit(0), limit - F.col("credits"))).filter("remaining is not null")


def ingestion_health(runs: DataFrame, as_of, interval_seconds: int = 900, by=()) -> DataFrame:
    """State of the latest run (of each group)."""
    latest = runs.groupBy(*by).agg(F.max_by(
        F.struct("run_id", "timestamp", "articles_ingested", "errors"), F.struct("timestamp", "run_id")).alias("r"))
    age = F.unix_micros(as_of_column(as_of)) / 1e6 - F.unix_micros("r.timestamp") / 1e6
    failed = F.size(F.coalesce("r.errors", F.array().cast("array<string>"))) > 0
    status = (
        F.when(F.col("r").isNull(), "warning").when(age > interval_seconds * 3, "stale")
        .when(failed & (F.col("r.articles_ingested") == 0), "failed").when(failed, "degraded").otherwise("ok")
    )
    return latest.select(*by, F.col("r.run_id").alias("run_id"), status.alias("status"),
                         F.round(age, 1).alias("seconds_since_last_run"))


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """Row counts per column value for several columns, and in total, in one pass."""
    sets = [[F.col(c)] for c in columns] + [[]]
    counted = df.groupingSets(sets, *[F.col(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id(*columns).alias("_g"))
    facet = F.lit("total")
    value = F.lit(None).cast("string")
    for i, c in enumerate(columns):
        mask = (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i))
        facet = F.when(F.col("_g") == mask, F.lit(c)).otherwise(facet)
        value = F.when(F.col("_g") == mask, F.col(c).cast("string")).otherwise(value)
    return counted.select(facet.alias("facet"), value.alias("value"), "n")


def duplicate_keys(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def url_surplus(df: DataFrame, url="url") -> DataFrame:
    """Rows beyond the first of each address."""
    per = df.groupBy(url).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("urls"), F.sum(F.col("n") - 1).alias("surplus"))


def coverage(cards: DataFrame, targets: DataFrame, column: str) -> DataFrame:
    """Published cards per target value, and the gap to the target.

    ``targets`` has name and target (a short list).
    """
    have = cards.groupBy(F.lower(column).alias("_name")).agg(F.count(F.lit(1)).alias("have"))
    have_col = F.coalesce("have", F.lit(0))
    return targets.join(have, F.lower("name") == F.col("_name"), "left").select(
        "name", "target", have_col.alias("have"), (have_col >= F.col("target")).alias("met"),
        F.greatest(F.lit(0), F.col("target") - have_col).alias("gap"))


def diversity_loss(ranked: DataFrame, by: Column, n: int, name: str = "bucket") -> DataFrame:
    """Per group: rows, rows within the first n ranks, and the loss."""
    counted = ranked.groupBy(by.alias(name)).agg(
        F.count(F.lit(1)).alias("valid"), F.count_if(F.col("rank") <= n).alias("survived"))
    lost = F.col("valid") - F.col("survived")
    return counted.select(name, "valid", "survived", lost.alias("lost"),
                          F.round(lost / F.col("valid") * 100, 4).alias("loss_pct"))


def profile(cards: DataFrame, columns, score: str | None = None, text: str | None = None) -> DataFrame:
    """Missing values per column, score range and text lengths in one pass."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        aggs.append(F.count_if(strip(text_or_empty(F.col(c).cast("string"))) == "").alias(f"missing_{c}"))
    if score:
        v = F.col(score).cast("double")
        aggs += [F.min(v).alias("min_score"), F.max(v).alias("max_score"),
                 F.count_if(F.isnan(v)).alias("nan_scores"),
                 F.count_if(~v.between(0.0, 100.0)).alias("out_of_range")]
    if text:
        w = word_count(F.col(text))
        aggs += [F.min(w).alias("min_words"), F.max(w).alias("max_words"), F.round(F.avg(w), 4).alias("avg_words")]
    return cards.agg(*aggs)


def audit_rates(verdicts: DataFrame) -> DataFrame:
    """Shares of wrong decisions among published and held stories."""
    wrong = F.when(F.col("is_published"), ~F.col("eligible") | F.col("flagged_conflict")).otherwise(
        F.col("eligible") & ~F.col("flagged_conflict"))

    def rate(scope, bad):
        return F.coalesce(F.round(F.avg(F.when(scope, bad.cast("double"))) * 100, 4), F.lit(0.0))

    pub = F.col("is_published")
    return verdicts.agg(
        rate(pub, wrong).alias("false_publish_pct"), rate(~pub, wrong).alias("false_hold_pct"),
        rate(pub, F.col("is_duplicate")).alias("duplicate_pct"),
        rate(pub, F.col("summary_error")).alias("summary_error_pct"))


def sweep_requests(requests: DataFrame, leases: DataFrame, as_of, max_age_seconds: int = 600,
                   max_attempts: int = 3) -> DataFrame:
    """Running requests that were abandoned go back to pending or fail.

    ``leases`` has worker_id, lease_generation and expires_at.
    """
    now = as_of_column(as_of)
    held = leases.filter(F.col("expires_at") > now).select(
        F.col("worker_id").alias("_w"), F.col("lease_generation").alias("_g"), F.lit(True).alias("_held")).distinct()
    joined = requests.join(
        held, (requests.worker_id == held["_w"]) & (requests.lease_generation == held["_g"]), "left").drop("_w", "_g")
    seen = [c for c in ("last_heartbeat_at", "started_at", "created_at") if c in requests.columns]
    age = F.coalesce(
        (F.unix_micros(now) - F.unix_micros(F.coalesce(*[F.col(c) for c in seen]))) / 1e6,
        F.lit(max_age_seconds + 1))
    lost = (F.col("status") == "running") & ((age > max_age_seconds) | F.col("_held").isNull())
    attempts = F.when(F.coalesce("attempt_count", F.lit(0)) == 0, 1).otherwise(F.col("attempt_count"))
    status = F.when(lost & (attempts < max_attempts), "pending").when(lost, "failed").otherwise(F.col("status"))
    return (
        joined.withColumn("swept", lost).withColumn("_status", status)
        .withColumn("worker_id", F.when(~(F.col("swept") & (F.col("_status") == "pending")), F.col("worker_id")))
        .withColumn("completed_at", F.when(F.col("swept") & (F.col("_status") == "failed"), now))
        .withColumn("status", F.col("_status")).drop("_status", "_held")
    )


def stratified_sample(df: DataFrame, by: str, ident: str, n: int, seed: str = "0") -> DataFrame:
    """n pseudo-random rows per class, the same for the same seed."""
    w = Window.partitionBy(by).orderBy(F.md5(F.concat_ws("|", F.col(ident).cast("string"), F.lit(seed))), ident)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def assemble_cards(articles: DataFrame, drafts: DataFrame) -> DataFrame:
    """Cards from clusters: the lead article gives place and category.

    ``articles``: cluster_id, ord, category, state, district, source_type;
    ``drafts``: cluster_id, headline, summary and optional overrides.
    """
    lead = articles.groupBy("cluster_id").agg(
        F.min_by(F.struct("category", "state", "district"), "ord").alias("_lead"),
        F.bool_or(F.coalesce(F.col("source_type") == "newsapi_dev_only", F.lit(False))).alias("_dev"),
    )
    joined = drafts.withColumnRenamed("category", "_cat") if "category" in drafts.columns else drafts.withColumn(
        "_cat", F.lit(None).cast("string"))
    return lead.join(joined, "cluster_id").select(
        "cluster_id", F.substring(text_or_empty(F.col("headline")), 1, 255).alias("headline"), "summary",
        F.coalesce("_cat", "_lead.category", F.lit("national")).alias("category"),
        F.col("_lead.state").alias("state"),
        F.when(F.col("_lead.district") != "", F.col("_lead.district")).alias("district"),
        F.when(F.col("_dev"), "dev_testing").otherwise("live_pipeline").alias("created_by"),
        F.lit("draft").alias("verified_status"))


def excerpts(articles: DataFrame, key: str = "cluster_id", order: str = "ord", chars: int = 800) -> DataFrame:
    """Review text per cluster: name, address, title and opening of each article."""
    part = F.concat_ws("\n", "name", "url", "title", F.substring(text_or_empty(F.col("body")), 1, chars))
    return articles.groupBy(key).agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))), lambda e: e["p"]),
            "\n\n-----\n\n").alias("source_excerpts"))


def rerun_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows a second pass would add; empty when the pass is idempotent."""
    return after.join(before.select(key), key, "left_anti")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


