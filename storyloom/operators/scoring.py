"""Story scores: importance, urgency, freshness, trust, relevance and their blend.

Everything but the trust score is a projection: one row in, one row out, no
shuffle.  The trust score aggregates card citations.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions.dates import age_minutes, as_of_column
from storyloom.functions.facts import casualties
from storyloom.functions.labels import scoring_publisher, scoring_tier
from storyloom.functions.signals import CASUALTY_WORDS, Signals, signal_words
from storyloom.functions.text import strip, text_or_empty

DIMENSIONS = list(K.DIMENSION_CAPS)


def _finding(score, evidence) -> Column:
    score = score if isinstance(score, Column) else F.lit(float(score))
    evidence = evidence if isinstance(evidence, Column) else F.lit(evidence)
    return F.struct(score.alias("score"), evidence.alias("evidence"))


class _Ladder:
    """First matching rung wins."""

    def __init__(self, text: Signals):
        self.text = text
        self.expr = None

    def rung(self, condition, score, evidence):
        if isinstance(condition, str):
            condition = self.text.has(condition)
        found = _finding(score, evidence)
        self.expr = F.when(condition, found) if self.expr is None else self.expr.when(condition, found)
        return self

    def rungs(self, rows):
        for pattern, score, evidence in rows:
            self.rung(pattern, score, evidence)
        return self

    def end(self, dimension):
        return self.expr.otherwise(_finding(0.0 if dimension != "geographic" else 2.0, K.NO_EVIDENCE[dimension]))


def combined_text(title, summary) -> Column:
    return F.lower(F.concat_ws(" ", text_or_empty(title), text_or_empty(summary)))


def is_isolated(text: Signals) -> Column:
    """A single accident or local crime without wide harm."""
    return text.has(K.ISOLATED) & ~text.has(K.WIDE_HARM)


def importance_dimensions(text: Signals, category, isolated, casualty) -> Column:
    """Eight (score, evidence) findings from lower-case text."""
    cat = F.lower(text_or_empty(category))
    notable = text.has(K.NOTABLE_PERSON) & ~text.has(K.MASS_HARM)
    count = F.format_number(casualty, 0)

    human = _Ladder(text)
    human.rung(casualty >= 1000, 20.0,
               F.concat(F.lit("Severe mass casualty event ("), count, F.lit(" documented deaths)")))
    human.rung(casualty >= 100, 16.0,
               F.concat(F.lit("Hundreds of documented casualties ("), count, F.lit(")")))
    human.rung(casualty >= 10, 12.0, F.concat(F.lit("Dozens of documented casualties ("), count, F.lit(")")))
    human.rung(casualty >= 2, 8.0, F.concat(F.lit("Multiple documented casualties ("), count, F.lit(")")))
    human.rung(
        casualty == 1,
        F.when(notable, F.lit(2.0)).when(isolated, F.lit(3.0)).otherwise(F.lit(6.0)),
        "Single casualty documented (1)",
    )
    human.rung(casualty.isNotNull(), 0.0, "")
    human.rungs(K.HUMAN_LADDER)
    human.rung(
        text.has(K.FATAL_ACCIDENT) & ~notable,
        F.when(isolated, F.lit(4.0)).otherwise(F.lit(8.0)), "Documented fatal accident",
    )
    human.rung(notable, 2.0, "Individual notable passing; no public harm")

    safety = _Ladder(text).rungs(K.SAFETY_LADDER)
    safety.rung(
        K.LOCAL_SAFETY, F.when(isolated, F.lit(3.0)).otherwise(F.lit(6.0)),
        "Localized law enforcement or traffic safety incident",
    )

    geographic = _Ladder(text).rung(isolated, 2.0, "Localized local traffic or safety incident")
    for pattern, cats, score, evidence in K.GEOGRAPHIC_LADDER:
        geographic.rung(cat.isin(cats) | text.has(pattern), score, evidence)

    economic = _Ladder(text).rung(isolated, 0.0, "No macroeconomic consequence").rungs(K.ECONOMIC_LADDER)
    economic.rung(
        (cat == "business") & text.has(K.BUSINESS_ROUTINE), 4.0, "Routine commercial/business activity"
    )

    cyber = text.has(K.CYBER)
    security = _Ladder(text)
    security.rung(
        cyber & text.has(K.CYBER_ESSENTIAL), 10.0, "High-risk cyberattack on essential public sector"
    )
    security.rung(cyber, 7.0, "Significant digital breach or cybersecurity threat")
    security.rungs(K.SECURITY_LADDER)

    return F.struct(
        human.end("human").alias("human"),
        safety.end("safety").alias("safety"),
        geographic.end("geographic").alias("geographic"),
        economic.end("economic").alias("economic"),
        _Ladder(text).rungs(K.POLICY_LADDER).end("policy").alias("policy"),
        _Ladder(text).rungs(K.INFRASTRUCTURE_LADDER).end("infrastructure").alias("infrastructure"),
        security.end("security").alias("security"),
        _Ladder(text).rungs(K.CONSEQUENCE_LADDER).end("consequence").alias("consequence"),
    )


def importance_total(dimensions: Column) -> Column:
    total = F.lit(0.0)
    for name, cap in K.DIMENSION_CAPS.items():
        total = total + F.least(dimensions[name]["score"], F.lit(cap))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 2)


def with_importance(df: DataFrame, title="headline", summary="summary", category="category") -> DataFrame:
    """Adds ``impact_evidence`` and ``importance_raw``.

    The lower-case text, the context flags and the casualty count are columns
    of their own, so that each is computed once per row.
    """
    signals = Signals(F.col("_text"), F.col("_signals"))
    return (
        with_signals(df, title, summary)
        .withColumn("_casualties", F.when(signals.any_word(CASUALTY_WORDS), casualties(F.col("_text"))))
        .withColumn(
            "impact_evidence",
            importance_dimensions(signals, F.col(category), F.col("_isolated"), F.col("_casualties")),
        )
        .withColumn("importance_raw", importance_total(F.col("impact_evidence")))
        .drop("_casualties")
    )


def with_signals(df: DataFrame, title="headline", summary="summary") -> DataFrame:
    """Adds the lower-case text, its gate words and the isolated-incident flag."""
    return (
        df.withColumn("_text", combined_text(F.col(title), F.col(summary)))
        .withColumn("_signals", signal_words(F.col("_text")))
        .withColumn("_isolated", is_isolated(Signals(F.col("_text"), F.col("_signals"))))
    )


def cap_lifestyle(importance, text: Signals) -> Column:
    return F.when(
        text.has(K.LIFESTYLE), F.least(importance, F.lit(K.LIFESTYLE_CAP))
    ).otherwise(importance)


def urgency(text: Signals, isolated, developing=None, action_required=None, external=None, external_reason=None) -> Column:
    """(score, reason) of how soon a reader has to know."""
    developing = F.coalesce(developing, F.lit(False)) if developing is not None else F.lit(False)
    action = F.coalesce(action_required, F.lit(False)) if action_required is not None else F.lit(False)

    def out(score, reason):
        reason = reason if isinstance(reason, Column) else F.lit(reason)
        score = score if isinstance(score, Column) else F.lit(score)
        return F.struct(score.alias("score"), reason.alias("reason"))

    now = (
        text.has(K.EMERGENCY_NOW)
        | text.evacuation()
        | (action & ~isolated)
    )
    crisis = ~isolated & (developing | text.has(K.CRISIS))
    rules = (
        F.when(now, out(95.0, K.URGENCY_TEXT[95.0]))
        .when(crisis, out(82.0, K.URGENCY_TEXT[82.0]))
        .when(text.has(K.ANNOUNCED_TODAY), out(60.0, K.URGENCY_TEXT[60.0]))
        .when(isolated, out(35.0, K.URGENCY_ISOLATED))
        .when(text.has(K.PROCEDURE), out(40.0, K.URGENCY_TEXT[40.0]))
        .when(text.has(K.RETROSPECTIVE), out(15.0, K.URGENCY_TEXT[15.0]))
        .otherwise(out(35.0, K.URGENCY_STANDARD))
    )
    if external is None:
        return rules
    why = F.lit(K.URGENCY_EXTERNAL)
    if external_reason is not None:
        why = F.when(text_or_empty(external_reason) != "", external_reason).otherwise(why)
    usable = F.coalesce(external.between(0.0, 100.0), F.lit(False))
    return (
        F.when(usable & isolated & (external >= 70.0), out(35.0, K.URGENCY_ISOLATED_EXTERNAL))
        .when(usable, out(F.bround(external.cast("double"), 2), why))
        .otherwise(rules)
    )


def freshness(published_at, as_of, event_time=None) -> Column:
    """Bracketed decay; unknown or future times get a cautious score."""
    ts = published_at if event_time is None else F.coalesce(event_time, published_at)
    age = age_minutes(ts, as_of)
    out = F.when(ts.isNull() | (age < 0), F.lit(K.FRESHNESS_UNKNOWN))
    for limit, score in K.FRESHNESS_BRACKETS:
        out = out.when(age <= limit, F.lit(score))
    return out.otherwise(F.lit(K.FRESHNESS_OLDEST))


def clean_order(category_order) -> Column:
    """A reader's category list in lower case, without blanks."""
    return F.filter(F.transform(category_order, lambda c: F.lower(strip(c))), lambda c: c != "")


def ranked_interest(category, order) -> Column:
    """Points by the position of a clean category in a clean list."""
    rank = F.array_position(order, category)
    ranked = F.greatest(F.lit(K.INTEREST_MINIMUM), F.lit(K.INTEREST_TOP) - (rank - 1) * F.lit(K.INTEREST_STEP))
    return F.when((category != "") & (F.coalesce(rank, F.lit(0)) > 0), ranked).otherwise(F.lit(K.INTEREST_UNRANKED))


def interest_score(category, category_order) -> Column:
    """Points by the rank of a category in a reader's ordered list."""
    return ranked_interest(F.lower(strip(text_or_empty(category))), clean_order(category_order))


def location_score(category, state, district, user_state, user_district) -> Column:
    def clean(c):
        return F.lower(strip(text_or_empty(c)))

    cat, st, di, ust, udi = (clean(c) for c in (category, state, district, user_state, user_district))
    both_district, both_state = (di != "") & (udi != ""), (st != "") & (ust != "")
    return (
        F.when(both_district & (di == udi), F.lit(K.LOCATION_DISTRICT))
        .when(both_state & (st == ust), F.lit(K.LOCATION_STATE))
        .when(both_district | both_state, F.lit(K.LOCATION_GLOBAL))
        .when(cat.isin("international", "world", "global"), F.lit(K.LOCATION_GLOBAL))
        .otherwise(F.lit(K.LOCATION_NATIONAL))
    )


def relevance(category, state, district, user_state, user_district, category_order) -> Column:
    return F.bround(
        location_score(category, state, district, user_state, user_district)
        + interest_score(category, category_order),
        2,
    )


def _clamp(c) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c.cast("double")))


def effective_importance(importance, urgency_score, fresh) -> Column:
    """Clamped importance, lifted to the floor by a fresh emergency."""
    imp, urg, frs = _clamp(importance), _clamp(urgency_score), _clamp(fresh)
    return F.when(
        (urg >= K.EMERGENCY_URGENCY) & (frs >= K.FRESH_THRESHOLD), F.greatest(imp, F.lit(K.EMERGENCY_FLOOR))
    ).otherwise(imp)


def decayed_base(importance, urgency_score, fresh, trust) -> Column:
    """The part of the final score that does not depend on the reader."""
    imp = effective_importance(importance, urgency_score, fresh)
    urg, frs, ver = _clamp(urgency_score), _clamp(fresh), _clamp(trust)
    imp = (
        F.when(frs < K.RECENT_THRESHOLD, imp * K.HISTORICAL_DECAY)
        .when(frs < K.FRESH_THRESHOLD, imp * K.RECENT_DECAY)
        .otherwise(imp)
    )
    urg = (
        F.when(frs < K.RECENT_THRESHOLD, F.least(urg, F.lit(K.HISTORICAL_URGENCY_CAP)))
        .when(frs < K.FRESH_THRESHOLD, F.least(urg, F.lit(K.RECENT_URGENCY_CAP)))
        .otherwise(urg)
    )
    return (
        imp * K.WEIGHT_IMPORTANCE
        + urg * K.WEIGHT_URGENCY
        + frs * K.WEIGHT_FRESHNESS
        + ver * K.WEIGHT_VERIFICATION
    )


def final_score(importance, urgency_score, fresh, relevance_score, trust) -> Column:
    total = decayed_base(importance, urgency_score, fresh, trust) + _clamp(relevance_score) * K.WEIGHT_RELEVANCE
    # a first rounding at ten places removes the order-of-addition noise
    return F.bround(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 10), 2)


def reason(dimensions, importance, urgency_score, fresh, relevance_score, trust,
           source_count, tier1_count, conflict) -> Column:
    """One sentence on why a story ranks where it does."""
    d = dimensions
    high = importance >= 70.0
    impact = (
        F.when(d["safety"]["score"] >= 12.0, F.lit("Major threat to public life and safety"))
        .when(d["security"]["score"] >= 7.0, F.lit("Critical cybersecurity / national security incident"))
        .when(d["human"]["score"] >= 12.0, F.lit("Substantial human casualty and displacement impact"))
        .when(d["policy"]["score"] >= 7.0, F.lit("Significant government policy or statutory change"))
        .when(d["economic"]["score"] >= 7.0, F.lit("High-consequence macroeconomic development"))
        .when(d["infrastructure"]["score"] >= 6.0, F.lit("Widespread public infrastructure disruption"))
        .when(high, F.lit("High overall civic importance"))
    )
    is_fresh = fresh >= K.FRESH_THRESHOLD
    pace = F.when(
        is_fresh & (urgency_score >= 85.0),
        F.lit("actively unfolding emergency requiring immediate public vigilance"),
    ).when(is_fresh & (urgency_score >= 65.0), F.lit("developing news event confirmed today"))
    place = F.when(relevance_score >= 75.0, F.lit("directly relevant to your local area"))
    n = source_count.cast("string")
    trust_clause = (
        F.when(conflict, F.lit("conflicting reports detected across sources"))
        .when((tier1_count >= 2) & (source_count >= 2),
              F.concat(F.lit("corroborated by "), n, F.lit(" major newsrooms")))
        .when(source_count >= 2, F.concat(F.lit("corroborated across "), n, F.lit(" independent sources")))
        .when(trust >= 85.0, F.lit("confirmed by verified primary wire service"))
    )
    clauses = F.array_compact(F.array(impact, pace, place, trust_clause))
    plain = F.when(
        importance < 35.0, F.lit("Routine informational update; low systemic public safety consequence.")
    ).otherwise(F.lit("Standard news coverage verified by regional reporting sources."))
    return F.when(F.size(clauses) == 0, plain).otherwise(
        F.concat(F.array_join(clauses, ", "), F.lit("."))
    )


def breakdown(importance, urgency_score, fresh, relevance_score, trust) -> Column:
    return F.struct(
        importance.alias("objective_importance"),
        urgency_score.alias("urgency"),
        fresh.alias("freshness"),
        relevance_score.alias("personal_relevance"),
        trust.alias("verification_confidence"),
        F.struct(
            F.lit(K.WEIGHT_IMPORTANCE).alias("importance"),
            F.lit(K.WEIGHT_URGENCY).alias("urgency"),
            F.lit(K.WEIGHT_FRESHNESS).alias("freshness"),
            F.lit(K.WEIGHT_RELEVANCE).alias("relevance"),
            F.lit(K.WEIGHT_VERIFICATION).alias("verification"),
        ).alias("weights"),
    )


def trust_scores(citations: DataFrame, key="card_id", order="ord", conflict=None) -> DataFrame:
    """Trust score per card from its citations (name, url, trust_tier).

    The first citation of each publisher decides its tier.  Two aggregations
    with map-side combine; nothing is collected per card.
    """
    tagged = citations.select(
        key,
        F.col(order).alias("_ord"),
        scoring_publisher(F.col("name"), F.col("url"), F.col("trust_tier")).alias("_pub"),
        scoring_tier(F.col("name")).alias("_tier"),
        (F.lit(False) if conflict is None else F.col(conflict)).alias("_conflict"),
    )
    first = tagged.groupBy(key, "_pub").agg(
        F.min_by("_tier", "_ord").alias("_tier"), F.count(F.lit(1)).alias("_n"), F.max("_conflict").alias("_conflict")
    )
    counted = F.col("_pub").isNotNull()
    per_card = first.groupBy(key).agg(
        F.sum("_n").alias("source_count"),
        F.count_if(counted).alias("independent_source_count"),
        F.count_if(counted & (F.col("_tier") == 1)).alias("tier1_source_count"),
        F.count_if(counted & (F.col("_tier") == 2)).alias("tier2_source_count"),
        F.max("_conflict").alias("conflict_detected"),
    )
    score, status = trust_ladder(
        F.col("independent_source_count"), F.col("tier1_source_count"), F.col("tier2_source_count"),
        F.col("conflict_detected"),
    )
    return per_card.withColumn("verification_score", score).withColumn("verification_status", status)


def trust_ladder(independent, tier1, tier2, conflict):
    rungs = [
        (conflict, F.lit(45.0), "flagged_conflict"),
        (tier1 >= 2, F.least(F.lit(100.0), 95.0 + independent), "cross_verified_tier1"),
        ((tier1 == 1) & (independent >= 2), F.lit(90.0), "cross_verified"),
        (tier1 == 1, F.lit(88.0), "official_wire_confirmed"),
        (independent >= 2, F.lit(82.0), "multi_source_corroborated"),
        (tier2 == 1, F.lit(70.0), "single_reputable_source"),
    ]
    score = status = None
    for condition, value, label in rungs:
        score = F.when(condition, value) if score is None else score.when(condition, value)
        status = F.when(condition, F.lit(label)) if status is None else status.when(condition, F.lit(label))
    return score.otherwise(F.lit(55.0)), status.otherwise(F.lit("single_unconfirmed_source"))


NO_SOURCES_TRUST = 40.0


def with_story_scores(cards: DataFrame, as_of, lifestyle_cap: bool = False) -> DataFrame:
    """Importance, urgency and freshness of each card, as one projection."""
    scored = with_importance(cards)
    signals = Signals(F.col("_text"), F.col("_signals"))
    imp = F.col("importance_raw")
    if lifestyle_cap:
        imp = cap_lifestyle(imp, signals)
    return (
        scored.withColumn("importance_base", imp)
        .withColumn("_urgency", urgency(signals, F.col("_isolated")))
        .withColumn("urgency_score", F.col("_urgency.score"))
        .withColumn("urgency_reason", F.col("_urgency.reason"))
        .withColumn("freshness_score", freshness(F.col("published_at"), as_of))
        .drop("_text", "_signals", "_isolated", "_urgency")
    )


def score_mismatch(cards: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Cards whose stored final score differs from the recomputed one."""
    again = final_score(
        F.col("importance_score"), F.col("urgency_score"), F.col("freshness_score"),
        F.col("personal_relevance_score"), F.col("verification_score"),
    )
    return cards.withColumn("expected_score", again).filter(
        F.abs(F.col("final_feed_score") - F.col("expected_score")) > tolerance
    )


def objective_scores(cards: DataFrame, articles: DataFrame, as_of) -> DataFrame:
    """Publish-time score per card: source weights, impact terms, tone, priority, decay.

    ``articles`` carries card_id, source_id, trust_tier, title and body.  Terms
    are tested row by row and combined with ``bool_or``, so no text is ever
    concatenated across a cluster.
    """
    from storyloom.functions.keywords import impact_hits

    hit_names = [f"_hit{i}" for i in range(len(K.WORKER_IMPACT_TERMS))]

    def hits(text):
        return [
            (impact_hits(text, [term]) > 0).alias(name)
            for term, name in zip(K.WORKER_IMPACT_TERMS, hit_names)
        ]

    body = F.concat_ws(" ", text_or_empty(F.col("title")), text_or_empty(F.col("body")))
    per_source = (
        articles.select("card_id", "source_id", "trust_tier", *hits(body))
        .groupBy("card_id", "source_id")
        .agg(
            F.max(F.when(F.col("trust_tier").isin("1", "official_local"), 1.5).otherwise(1.0)).alias("_w"),
            *[F.bool_or(n).alias(n) for n in hit_names],
        )
    )
    per_card = per_source.groupBy("card_id").agg(
        F.sum(F.when(F.col("source_id").isNotNull(), F.col("_w")).otherwise(0.0)).alias("_sources"),
        *[F.bool_or(n).alias(n) for n in hit_names],
    )
    own = cards.select("*", *[h.alias("_own" + n) for h, n in zip(
        hits(F.concat_ws(" ", text_or_empty(F.col("headline")), text_or_empty(F.col("summary")))), hit_names)])
    joined = own.join(per_card, "card_id", "left")
    count = F.lit(0)
    for n in hit_names:
        count = count + (F.col("_own" + n) | F.coalesce(F.col(n), F.lit(False))).cast("int")
    source_score = (
        F.when(F.col("_sources").isNull(), 0.0).when(F.col("_sources") == 0, 1.0).otherwise(F.col("_sources"))
    )
    tone = (
        F.least(F.abs(F.col("gdelt_tone")) * 0.2, F.lit(3.0)) if "gdelt_tone" in cards.columns else F.lit(0.0)
    )
    priority = F.coalesce(F.col("priority_score"), F.lit(5)).cast("double")
    boost = F.when(priority <= 2, F.lit(-100.0)).otherwise(priority * priority * 2.0)
    now = as_of_column(as_of)
    hours = F.greatest(F.lit(0.0), age_minutes(F.coalesce(F.col("published_at"), now), now) / 60.0)
    base = F.greatest(F.lit(0.0), source_score + count * 2.0 + F.coalesce(tone, F.lit(0.0)) + boost)
    drop = hit_names + ["_own" + n for n in hit_names] + ["_sources"]
    return (
        joined.withColumn("impact_keywords_count", count)
        .withColumn("objective_score", F.round(base * F.exp(-0.028 * hours), 3))
        .drop(*drop)
    )


def recent_published(cards: DataFrame, as_of, max_age_hours: int = 48) -> DataFrame:
    """Published cards young enough for a decay refresh."""
    cutoff = as_of_column(as_of) - F.expr(f"INTERVAL {int(max_age_hours)} HOURS")
    return cards.filter((F.col("verified_status") == "published") & (F.col("published_at") >= cutoff))


def refresh_decay(cards: DataFrame, articles: DataFrame, as_of, max_age_hours: int = 48) -> DataFrame:
    """Cards with the objective score of recent ones brought up to date."""
    recent = recent_published(cards, as_of, max_age_hours)
    fresh = objective_scores(
        recent.drop("objective_score", "impact_keywords_count"),
        articles.join(recent.select("card_id"), "card_id", "left_semi"), as_of,
    ).select("card_id", F.col("objective_score").alias("_score"), F.col("impact_keywords_count").alias("_hits"))
    return (
        cards.join(fresh, "card_id", "left")
        .withColumn("objective_score", F.coalesce("_score", "objective_score"))
        .withColumn("impact_keywords_count", F.coalesce("_hits", "impact_keywords_count"))
        .drop("_score", "_hits")
    )
