"""Row predicates and routing of articles and cards."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions import text as X
from storyloom.functions.dates import as_of_column, parse_ts
from storyloom.functions.labels import any_contains
from storyloom.functions.text import strip, text_or_empty


def _blank(name: str) -> Column:
    return strip(text_or_empty(F.col(name).cast("string"))) == ""


def required_reason(title="title", link="link", source="source", category="category",
                    published="published_date") -> Column:
    """Why a crawled record is refused, or "valid"."""
    return (
        F.when(_blank(title), "missing_title")
        .when(_blank(link), "missing_link")
        .when(_blank(source), "missing_source")
        .when(_blank(category), "missing_category")
        .when(~_blank(published) & parse_ts(F.col(published)).isNull(), "invalid_timestamp")
        .otherwise("valid")
    )


def validate_required(df: DataFrame, **names) -> DataFrame:
    return df.withColumn("reason", required_reason(**names))


def drop_low_value(df: DataFrame, title="title", phrases=K.LOW_VALUE_CRAWL) -> DataFrame:
    """Without puzzle hints, horoscopes and the like."""
    return df.filter(~any_contains(F.lower(text_or_empty(F.col(title))), phrases))


def within_hours(df: DataFrame, as_of, back: int = 72, ahead: int = 2, ts="published_at") -> DataFrame:
    now = as_of_column(as_of)
    return df.filter(
        (F.col(ts) >= now - F.expr(f"INTERVAL {int(back)} HOURS"))
        & (F.col(ts) <= now + F.expr(f"INTERVAL {int(ahead)} HOURS"))
    )


def public_cards(cards: DataFrame) -> DataFrame:
    """Published news by authentic creators without boilerplate text."""
    keep = (
        (F.col("verified_status") == "published")
        & F.col("created_by").isin(K.PUBLIC_CREATORS)
        & (F.col("content_type") == "NEWS")
    )
    for phrase in K.FEED_BOILERPLATE:
        keep = keep & ~F.contains("summary", F.lit(phrase))
    return cards.filter(keep)


def canonical_wanted(categories) -> list[str]:
    """Requested categories in canonical form; "all" means no filter."""
    out = []
    for c in categories:
        c = c.strip()
        if c and c.lower() != "all":
            out.append((K.FEED_SYNONYMS.get(c.lower(), [c])[0]).capitalize())
    return out


def by_category(cards: DataFrame, categories, synonyms=K.FEED_SYNONYMS) -> DataFrame:
    """Case-insensitive category filter, widened by synonyms."""
    wanted = sorted({s for c in canonical_wanted(categories) for s in [c.lower()] + synonyms.get(c.lower(), [])})
    return cards.filter(F.lower("category").isin(wanted)) if wanted else cards


def state_desk(cards: DataFrame, categories, state: str | None) -> DataFrame:
    """When State alone is asked for: that state's cards and those of no state."""
    wanted = canonical_wanted(categories)
    if state and len(wanted) == 1 and wanted[0].lower() == "state":
        return cards.filter((F.lower("state") == state.strip().lower()) | F.col("state").isNull())
    return cards


def feed_legacy(cards: DataFrame, categories=(), district=None, state=None) -> DataFrame:
    """Published cards by exact category, district and state, newest first."""
    out = cards.filter(F.col("verified_status") == "published")
    if categories:
        out = out.filter(F.col("category").isin(list(categories)))
    if district:
        out = out.filter(F.col("district") == district)
    if state:
        out = out.filter(F.col("state") == state)
    return out.orderBy(F.desc("published_at"), F.desc("created_at"), F.desc("card_id"))


def boosted(cards: DataFrame, district: str | None, state: str | None) -> DataFrame:
    """Local-or-neutral published cards with a location boost on the score."""
    out = cards.filter((F.col("verified_status") == "published") & (
        F.col("created_by").isNull() | (F.col("created_by") != "dev_testing")))
    boost = F.lit(0.0)
    if district:
        out = out.filter((F.col("district") == district) | F.col("district").isNull())
        boost = boost + F.when(F.col("district") == district, 50.0).otherwise(0.0)
    if state:
        out = out.filter((F.col("state") == state) | F.col("state").isNull())
        boost = boost + F.when(F.col("state") == state, 20.0).otherwise(0.0)
    return out.withColumn("boosted_score", F.col("objective_score") + boost)


def search(df: DataFrame, text: str, columns=("headline", "summary")) -> DataFrame:
    """Case-insensitive substring search over any of the columns."""
    needle = F.lit(text.strip().lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(text_or_empty(F.col(c))), needle)
    return df.filter(hit)


def by_topic(df: DataFrame, topic: str) -> DataFrame:
    joined = F.concat_ws(" ", text_or_empty(F.col("headline")), text_or_empty(F.col("summary")))
    return df.filter(F.contains(F.lower(joined), F.lit(topic.lower())))


def purge_boilerplate(cards: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards without synthetic boilerplate, and the citations of kept cards."""
    phrases = K.PURGE_BOILERPLATE
    clean = cards.filter(~any_contains(text_or_empty(F.col("summary")), phrases))
    gone = cards.filter(any_contains(text_or_empty(F.col("summary")), phrases)).select("card_id")
    return clean, citations.join(gone, "card_id", "left_anti")


def _number(c: Column) -> Column:
    return c.cast("string")


def quality_reasons(summary) -> Column:
    """All failed rules of the summary gate, as an array of reasons."""
    words, sentences = X.word_count(summary), X.sentence_count(summary)
    grade, banned = X.fk_grade(summary), X.token_hits(summary, K.BANNED_OPINION)
    limits = K.QUALITY_LIMITS

    def outside(value, name):
        low, high = limits[name]
        return ~value.between(low, high)

    return F.array_compact(F.array(
        F.when(outside(words, "words"), F.concat(F.lit("word_count:"), _number(words))),
        F.when(outside(sentences, "sentences"), F.concat(F.lit("sentence_count:"), _number(sentences))),
        F.when(outside(grade, "grade"), F.concat(F.lit("reading_level:"), _number(grade))),
        F.when(F.size(banned) > 0, F.concat(F.lit("banned_words:"), F.array_join(banned, ","))),
    ))


def quality_gate(df: DataFrame, summary="summary") -> DataFrame:
    return df.withColumn("reasons", quality_reasons(F.col(summary))).withColumn(
        "passed", F.size("reasons") == 0)


def revalidate(cards: DataFrame, low: int = 150, high: int = 200) -> tuple[DataFrame, DataFrame]:
    """Published cards with summaries of odd length go to review."""
    counted = cards.withColumn("_words", X.word_count(F.col("summary")))
    odd = (F.col("verified_status") == "published") & ~F.col("_words").between(low, high)
    swept = (
        counted.withColumn("_odd", odd)
        .withColumn("verified_status", F.when(F.col("_odd"), "pending_review").otherwise(F.col("verified_status")))
        .withColumn("published_at", F.when(~F.col("_odd"), F.col("published_at")))
        .drop("_words", "_odd")
    )
    reviews = counted.filter(odd).select(
        "card_id",
        F.array(F.concat(F.lit("legacy_summary_word_count:"), F.col("_words").cast("string"))).alias("reasons"),
        F.lit("").alias("source_excerpts"), F.lit("pending").alias("status"),
    )
    return swept, reviews


def coerce_card(df: DataFrame) -> DataFrame:
    """Known content types only; a priority that is no number becomes 5."""
    kind = F.upper(strip(F.coalesce(F.col("content_type").cast("string"), F.lit("NEWS"))))
    return df.withColumn(
        "content_type", F.when(kind.isin(K.CONTENT_TYPES), kind).otherwise(F.lit("UNKNOWN"))
    ).withColumn(
        "priority_score", F.coalesce(F.col("priority_score").cast("string").try_cast("int"), F.lit(5))
    )


def route_review(cards: DataFrame, titles="article_titles", conflict="flagged_conflict",
                 verdict=None) -> DataFrame:
    """Reasons that hold a card back, and the status that follows.

    ``titles`` is an array of article titles (or text); ``verdict`` an optional
    array column of issues from an outside fact check.
    """
    text = F.concat_ws(" ", text_or_empty(F.col("headline")), text_or_empty(F.col("summary")), F.col(titles))
    reasons = F.array_compact(F.array(
        F.when(F.col("content_type") != "NEWS", F.concat(F.lit("content_type:"), "content_type")),
        F.when(F.col(conflict), F.lit("flagged_conflict")),
        F.when(X.has_any_token(text, K.SENSITIVITY), F.lit("sensitivity_keyword")),
    ))
    parts = [reasons, quality_reasons(F.col("summary"))]
    if verdict is not None:
        parts.append(F.coalesce(F.col(verdict), F.array().cast("array<string>")))
    return cards.withColumn("reasons", F.concat(*parts)).withColumn(
        "verified_status", F.when(F.size("reasons") == 0, F.lit("published")).otherwise(F.lit("pending_review")))


def active_sources(sources: DataFrame, excluded=("newsdata_api", "newsapi_dev_only")) -> DataFrame:
    return sources.filter(F.col("is_active") & ~F.col("source_type").isin(list(excluded)))


def apply_decisions(cards: DataFrame, decisions: DataFrame, as_of) -> DataFrame:
    """Editor decisions: approval keeps the source date, rejection clears it."""
    verdict = F.col("decision")
    return (
        cards.join(decisions.select("card_id", "decision"), "card_id", "left")
        .withColumn("verified_status", F.when(verdict == "approve", "published")
                    .when(verdict == "reject", "rejected").otherwise(F.col("verified_status")))
        .withColumn("published_at", F.when(F.coalesce(verdict, F.lit("")) != "reject", F.col("published_at")))
        .withColumn("feed_published_at", F.when(verdict == "approve", as_of_column(as_of)))
        .drop("decision")
    )


def saved(cards: DataFrame, marks: DataFrame) -> DataFrame:
    return cards.join(marks.select("card_id").distinct(), "card_id", "left_semi")


def unseen(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """(device, card) rows the device has not seen."""
    return pairs.join(marks.select("device_id", "card_id").distinct(), ["device_id", "card_id"], "left_anti")


def pending_reviews(reviews: DataFrame, cards: DataFrame, citations: DataFrame) -> DataFrame:
    """Pending items, newest first, with card and sources."""
    from storyloom.operators.joins import with_sources

    pending = reviews.filter(F.col("status") == "pending")
    return with_sources(pending.join(cards, "card_id"), citations).orderBy(
        F.desc("created_at"), F.desc("card_id"))


