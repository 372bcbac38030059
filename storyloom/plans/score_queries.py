"""Scores, trust and ranked feeds."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions import text
from storyloom.functions.signals import Signals
from storyloom.operators import feed as R
from storyloom.operators import filters as P
from storyloom.operators import scoring as S
from storyloom.operators import verification as C
from storyloom.operators.ranks import positions
from storyloom.plans import fixtures as V
from storyloom.plans import scoring_sql as SQ
from storyloom.plans import sqltext as Q
from storyloom.plans.registry import query
from storyloom.plans.text_queries import PROVENANCE

DIMS = ["human", "safety", "geographic", "economic", "policy", "infrastructure", "security", "consequence"]


def _scored(spark, folder):
    """Public cards with every reader-independent score."""
    return R.scored_cards(V.cards(spark, folder), V.card_sources(spark, folder), V.AS_OF)


@query("importance", "WITH " + SQ.DIMS_SQL + " SELECT card_id, " + ", ".join(DIMS) + ", total AS importance FROM sums_v")
def importance(spark, folder):
    return S.with_importance(V.cards(spark, folder)).select(
        "card_id", *[F.col(f"impact_evidence.{d}.score").alias(d) for d in DIMS], F.col("importance_raw").alias("importance"))


@query("cap_lifestyle", "WITH " + SQ.DIMS_SQL
       + f" SELECT card_id, {SQ._CAPPED} AS importance FROM sums_v")
def cap_lifestyle(spark, folder):
    return S.with_importance(V.cards(spark, folder)).select(
        "card_id", S.cap_lifestyle(
            F.col("importance_raw"), Signals(F.col("_text"), F.col("_signals"))).alias("importance"))


@query("urgency", "WITH " + SQ.DIMS_SQL + """
SELECT card_id, urgency, CASE WHEN isolated AND ext >= 70 THEN 35.0 ELSE ext END AS external_urgency FROM (
  SELECT *, CAST(card_id % 101 AS DOUBLE) AS ext FROM sums_v)""")
def urgency(spark, folder):
    df = S.with_signals(V.cards(spark, folder))
    signals = Signals(F.col("_text"), F.col("_signals"))
    ext = (F.col("card_id") % 101).cast("double")
    return df.select(
        "card_id", S.urgency(signals, F.col("_isolated"))["score"].alias("urgency"),
        S.urgency(signals, F.col("_isolated"), external=ext)["score"].alias("external_urgency"))


@query("freshness", "WITH " + V.ARTICLES_SQL + f" SELECT id, {SQ.FRESHNESS} AS freshness FROM articles_v")
def freshness(spark, folder):
    return V.articles(spark, folder).select("id", S.freshness(F.col("published_at"), V.AS_OF).alias("freshness"))


def _card_reader(spark, folder):
    """Every reader with the card of the same number."""
    return V.cards(spark, folder).join(V.users(spark, folder), F.col("card_id") == F.col("device_id"))


@query("relevance", "WITH " + V.CARDS_SQL + ", " + V.USERS_SQL + f"""
SELECT card_id, {SQ.location('state', 'district', 'user_state', 'user_district')} AS location,
  {SQ.interest('category', 'category_order')} AS interest,
  {SQ.location('state', 'district', 'user_state', 'user_district')} + {SQ.interest('category', 'category_order')} AS relevance
FROM cards_v JOIN users_v ON card_id = device_id""")
def relevance(spark, folder):
    c = [F.col(x) for x in ("category", "state", "district", "user_state", "user_district")]
    order = F.coalesce("category_order", F.array().cast("array<string>"))
    return _card_reader(spark, folder).select(
        "card_id", S.location_score(*c).alias("location"), S.interest_score(F.col("category"), order).alias("interest"),
        S.relevance(*c, order).alias("relevance"))


@query("interest_score", "WITH " + V.USERS_SQL + f"""
SELECT device_id, {SQ.interest("'Science'", 'category_order')} AS science, {SQ.interest("'Motoring'", 'category_order')} AS motoring
FROM users_v""")
def interest_score(spark, folder):
    order = F.coalesce("category_order", F.array().cast("array<string>"))
    return V.users(spark, folder).select(
        "device_id", S.interest_score(F.lit("Science"), order).alias("science"),
        S.interest_score(F.lit("Motoring"), order).alias("motoring"))


_EVENT_SCORES = "SELECT event_id, value AS importance, value * 2 AS urgency, CAST(event_id % 30 AS DOUBLE) AS freshness, value / 2 AS rel, value AS trust"


@query("final_score", f"""
WITH e AS ({_EVENT_SCORES} FROM events),
c AS (SELECT event_id, least(100, greatest(0, importance)) AS i, least(100, greatest(0, urgency)) AS u,
  least(100, greatest(0, freshness)) AS f, least(100, greatest(0, rel)) AS r, least(100, greatest(0, trust)) AS v FROM e),
x AS (SELECT *, CASE WHEN u >= 90 AND f >= 25 THEN greatest(i, 75.0) ELSE i END AS imp FROM c)
SELECT event_id, imp AS effective_importance, CAST(round(CAST(least(100, greatest(0,
  imp * (CASE WHEN f < 10 THEN 0.40 WHEN f < 25 THEN 0.75 ELSE 1 END) * 0.40
  + (CASE WHEN f < 10 THEN least(u, 25.0) WHEN f < 25 THEN least(u, 45.0) ELSE u END) * 0.20 + f * 0.15 + r * 0.15 + v * 0.10)) AS DECIMAL(18, 10)), 1) AS DOUBLE)
  AS final_score FROM x""")
def final_score(spark, folder):
    e = V.table(spark, folder, "events")
    v, n = F.col("value"), (F.col("event_id") % 30).cast("double")
    total = S.decayed_base(v, v * 2, n, v) + S._clamp(v / 2) * K.WEIGHT_RELEVANCE
    # a first rounding at ten places, as in scoring.final_score, removes the order-of-addition noise
    return e.select(
        "event_id", S.effective_importance(v, v * 2, n).alias("effective_importance"),
        F.round(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 10), 1).alias("final_score"))


_REASON = """CASE WHEN len(cl) > 0 THEN array_to_string(cl, ', ') || '.' WHEN importance < 35 THEN
  'Routine informational update; low systemic public safety consequence.'
  ELSE 'Standard news coverage verified by regional reporting sources.' END"""
_CLAUSES = """list_filter([CASE WHEN safety >= 12 THEN 'Major threat to public life and safety'
    WHEN security >= 7 THEN 'Critical cybersecurity / national security incident'
    WHEN human >= 12 THEN 'Substantial human casualty and displacement impact'
    WHEN policy >= 7 THEN 'Significant government policy or statutory change'
    WHEN economic >= 7 THEN 'High-consequence macroeconomic development'
    WHEN infrastructure >= 6 THEN 'Widespread public infrastructure disruption'
    WHEN importance >= 70 THEN 'High overall civic importance' END,
  CASE WHEN freshness >= 25 AND urgency >= 85 THEN 'actively unfolding emergency requiring immediate public vigilance'
    WHEN freshness >= 25 AND urgency >= 65 THEN 'developing news event confirmed today' END,
  CASE WHEN rel >= 75 THEN 'directly relevant to your local area' END,
  CASE WHEN tier1_count >= 2 AND source_count >= 2 THEN 'corroborated by ' || source_count || ' major newsrooms'
    WHEN source_count >= 2 THEN 'corroborated across ' || source_count || ' independent sources'
    WHEN trust >= 85 THEN 'confirmed by verified primary wire service' END], lambda x: x IS NOT NULL)"""
_RESCORE_SQL = SQ.PUBLISHED_SQL + f""",
r_v AS (SELECT *, {SQ.location('NULL', 'NULL', 'NULL', 'NULL')} + 25.0 AS rel FROM scored_v),
c_v AS (SELECT *, {_CLAUSES} AS cl FROM r_v)"""


@query("rescore", "WITH " + _RESCORE_SQL + f"""
SELECT card_id, importance, urgency, freshness, trust, rel AS relevance, round(base + rel * 0.15, 2) AS final_score,
  {_REASON} AS reason FROM c_v""")
def rescore(spark, folder):
    """Every published card through all scores, with the reason sentence."""
    out = R.rescore(V.cards(spark, folder), V.card_sources(spark, folder), V.AS_OF)
    return out.select(
        "card_id", F.col("importance_score").alias("importance"), F.col("urgency_score").alias("urgency"),
        F.col("freshness_score").alias("freshness"), F.col("verification_score").alias("trust"),
        F.col("personal_relevance_score").alias("relevance"), F.col("final_feed_score").alias("final_score"),
        F.col("priority_reason").alias("reason"))


@query("score_breakdown", "WITH " + _RESCORE_SQL + """
SELECT card_id, importance AS objective_importance, urgency, freshness, rel AS personal_relevance,
  trust AS verification_confidence, 1.0 AS weight_sum FROM c_v""")
def score_breakdown(spark, folder):
    out = R.rescore(V.cards(spark, folder), V.card_sources(spark, folder), V.AS_OF)
    w = F.col("breakdown.weights")
    total = sum((w[n] for n in ("urgency", "freshness", "relevance", "verification")), w["importance"])
    return out.select(
        "card_id", *[F.col(f"breakdown.{n}").alias(n) for n in (
            "objective_importance", "urgency", "freshness", "personal_relevance", "verification_confidence")],
        F.round(total, 6).alias("weight_sum"))


@query("score_mismatch", "WITH " + _RESCORE_SQL + """
SELECT card_id, round(base + rel * 0.15 + card_id % 3, 2) AS stored, round(base + rel * 0.15, 2) AS expected
FROM c_v WHERE card_id % 3 <> 0""")
def score_mismatch(spark, folder):
    """Two thirds of the stored scores are off; the audit finds them."""
    out = R.rescore(V.cards(spark, folder), V.card_sources(spark, folder), V.AS_OF)
    off = out.withColumn("final_feed_score", F.col("final_feed_score") + F.col("card_id") % 3)
    return S.score_mismatch(off).select(
        "card_id", F.round("final_feed_score", 2).alias("stored"), F.col("expected_score").alias("expected"))


@query("trust_scores", "WITH " + V.CARD_SOURCES_SQL + SQ.trust("url") + """
SELECT card_id, source_count, CAST(ind AS BIGINT) AS independent, CAST(one AS BIGINT) AS tier1, trust, status FROM trust_v""")
def trust_scores(spark, folder):
    return S.trust_scores(V.card_sources(spark, folder)).select(
        "card_id", "source_count", F.col("independent_source_count").alias("independent"),
        F.col("tier1_source_count").alias("tier1"), F.col("verification_score").alias("trust"),
        F.col("verification_status").alias("status"))


@query("corroboration", "WITH " + V.CARD_SOURCES_SQL + f""",
p AS (SELECT *, CASE WHEN {PROVENANCE} <> 'unresolved' AND trim(name) <> '' THEN lower(trim(name)) END AS n FROM card_sources_v),
g AS (SELECT card_id, count(DISTINCT n) AS names, count(*) AS c FROM p GROUP BY 1)
SELECT card_id, CASE WHEN names > 0 THEN names ELSE c END AS corroboration_count,
  CASE WHEN names > 0 THEN names ELSE c END <= 1 AS is_single_source,
  CASE WHEN c <= 1 OR CASE WHEN names > 0 THEN names ELSE c END <= 1 THEN 'single_source' ELSE 'cross_verified' END AS shown_type
FROM g""")
def corroboration(spark, folder):
    out = C.corroboration(V.card_sources(spark, folder))
    return out.select("card_id", "corroboration_count", "is_single_source", C.guarded_type(
        F.lit("cross_verified"), F.col("is_single_source"), F.col("n_sources")).alias("shown_type"))


def _objective_sql(where):
    t = Q.ascii_words("lower(coalesce(headline, '') || ' ' || coalesce(summary, ''))")
    own = [Q.matches("own_t", rf"\b{w}\b") for w in K.WORKER_IMPACT_TERMS]
    art = [Q.matches("art_t", rf"\b{w}\b") for w in K.WORKER_IMPACT_TERMS]
    hits = " + ".join(f"CAST({o} OR coalesce(bool_or({a}), false) AS INT)" for o, a in zip(own, art))
    return V.CARD_SOURCES_SQL + f""",
j AS (SELECT c.card_id, {t} AS own_t, c.published_at, c.priority_score, x.source_id, x.trust_tier,
    {Q.ascii_words("lower(a.title || ' ' || a.raw_text)")} AS art_t
  FROM cards_v c LEFT JOIN card_sources_v x USING (card_id) LEFT JOIN articles_v a ON a.id = x.article_id WHERE {where}),
s AS (SELECT card_id, sum(w) AS sources FROM (
  SELECT card_id, source_id, max(CASE WHEN trust_tier IN ('1', 'official_local') THEN 1.5 ELSE 1.0 END) AS w
  FROM j WHERE source_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT card_id, own_t, published_at, priority_score, {hits} AS hits FROM j GROUP BY 1, 2, 3, 4),
objective_v AS (SELECT card_id, CAST(hits AS BIGINT) AS hits,
  round(greatest(0.0, coalesce(sources, 0) + hits * 2.0
    + CASE WHEN priority_score <= 2 THEN -100.0 ELSE priority_score * priority_score * 2.0 END)
  * exp(-0.028 * greatest(0.0, (epoch_us(TIMESTAMP '{V.AS_OF}')
      - epoch_us(coalesce(published_at, TIMESTAMP '{V.AS_OF}'))) / 3600000000.0)), 3) AS objective_score
  FROM h LEFT JOIN s USING (card_id))"""


def _cited(spark, folder):
    arts = V.articles(spark, folder).select(F.col("id").alias("article_id"), "title", F.col("raw_text").alias("body"))
    return V.card_sources(spark, folder).join(arts, "article_id")


@query("objective_score", "WITH " + _objective_sql("true") + " SELECT * FROM objective_v")
def objective_score(spark, folder):
    return S.objective_scores(V.cards(spark, folder), _cited(spark, folder), V.AS_OF).select(
        "card_id", F.col("impact_keywords_count").cast("bigint").alias("hits"), "objective_score")


_RECENT = f"verified_status = 'published' AND published_at >= TIMESTAMP '{V.AS_OF}' - INTERVAL 48 HOURS"


@query("refresh_decay", "WITH " + _objective_sql(_RECENT.replace('verified_status', 'c.verified_status').replace('published_at', 'c.published_at')) + """
SELECT c.card_id, coalesce(o.objective_score, 9.99) AS objective_score, coalesce(o.hits, 1) AS hits
FROM cards_v c LEFT JOIN objective_v o USING (card_id)""")
def refresh_decay(spark, folder):
    cards = V.cards(spark, folder).withColumn("objective_score", F.lit(9.99)).withColumn("impact_keywords_count", F.lit(1))
    return S.refresh_decay(cards, _cited(spark, folder), V.AS_OF).select(
        "card_id", "objective_score", F.col("impact_keywords_count").cast("bigint").alias("hits"))


# --- feeds -----------------------------------------------------------------------

@query("public_feed_scores", "WITH " + SQ.PUBLIC_SQL
       + " SELECT card_id, importance, urgency, freshness, trust, base FROM scored_v")
def public_feed_scores(spark, folder):
    return _scored(spark, folder).select(
        "card_id", F.col("importance_score").alias("importance"), F.col("urgency_score").alias("urgency"),
        F.col("freshness_score").alias("freshness"), F.col("verification_score").alias("trust"),
        F.round("base_score", 2).alias("base"))


@query("user_feeds", "WITH " + SQ.PUBLIC_SQL + ", " + V.USERS_SQL + f""",
all_v AS (SELECT device_id, card_id, cluster_id, published_at, created_at,
    {SQ.location('state', 'district', 'user_state', 'user_district')} + {SQ.interest('category', 'category_order')} AS relevance, base
  FROM scored_v CROSS JOIN users_v),
f_v AS (SELECT *, round(round(least(100.0, greatest(0.0, base + relevance * 0.15)), 10), 2) AS final_feed_score FROM all_v),
b_v AS (SELECT * FROM f_v QUALIFY row_number() OVER (PARTITION BY device_id, cluster_id ORDER BY final_feed_score DESC,
    coalesce(epoch(published_at), 0) DESC, coalesce(epoch(created_at), 0) DESC, card_id DESC) = 1)
SELECT device_id, CAST(rank AS BIGINT) AS rank, card_id, cluster_id, relevance, final_feed_score FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY final_feed_score DESC,
    coalesce(epoch(published_at), 0) DESC, coalesce(epoch(created_at), 0) DESC, card_id DESC) AS rank FROM b_v) WHERE rank <= 10""")
def user_feeds(spark, folder):
    """Top ten of the ranked feed for every reader."""
    out = R.user_feeds(_scored(spark, folder), V.users(spark, folder), 0, 10)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


_FEED_ORDER_SQL = "base DESC, coalesce(epoch(published_at), 0) DESC, coalesce(epoch(created_at), 0) DESC, card_id DESC"


def _ranked(spark, folder):
    return _scored(spark, folder).withColumn("final_feed_score", F.round("base_score", 2))


@query("best_per_cluster", "WITH " + SQ.PUBLIC_SQL + """
SELECT cluster_id, card_id, base AS score FROM scored_v
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY base DESC, card_id) = 1""")
def best_per_cluster(spark, folder):
    return R.best_per_cluster(_ranked(spark, folder)).select(
        "cluster_id", "card_id", F.col("final_feed_score").alias("score"))


@query("order_feed", "WITH " + SQ.PUBLIC_SQL + f"""
SELECT card_id, CAST(row_number() OVER (ORDER BY CASE WHEN lower(state) = 'goa' THEN 2
  WHEN contains(lower(headline || ' ' || coalesce(district, '')), 'goa') THEN 1 ELSE 0 END DESC, {_FEED_ORDER_SQL}) AS BIGINT) AS position
FROM scored_v""")
def order_feed(spark, folder):
    """All places of the state tab."""
    order = [R.state_priority(F.col("state"), F.col("headline"), F.col("district"), F.lit("Goa")).desc(),
             F.desc("final_feed_score"), R.epoch("published_at").desc(), R.epoch("created_at").desc(), F.desc("card_id")]
    return positions(_ranked(spark, folder), order).select("card_id", F.col("position").cast("bigint").alias("position"))


@query("feed_page", "WITH " + SQ.PUBLIC_SQL + f"""
SELECT card_id, CAST(rank AS BIGINT) AS rank, total FROM (
  SELECT card_id, row_number() OVER (ORDER BY {_FEED_ORDER_SQL}) AS rank, count(*) OVER () AS total FROM scored_v)
WHERE rank > 20 AND rank <= 40""")
def feed_page(spark, folder):
    order = [F.desc("final_feed_score"), R.epoch("published_at").desc(), R.epoch("created_at").desc(), F.desc("card_id")]
    return R.page(_ranked(spark, folder), 20, 20, order).select("card_id", F.col("rank").cast("bigint").alias("rank"), "total")


@query("order_violations", "WITH " + V.CARDS_SQL + """
SELECT card_id, score, next_score FROM (SELECT card_id, priority_score AS score,
  lead(priority_score) OVER (PARTITION BY state ORDER BY card_id) AS next_score FROM cards_v) WHERE next_score > score""")
def order_violations(spark, folder):
    return R.order_violations(V.cards(spark, folder), "card_id", "priority_score", ("state",)).select(
        "card_id", F.col("priority_score").alias("score"), "next_score")


_POOLS = ", ".join(
    f"CASE WHEN pool <= {n} THEN rank() OVER (PARTITION BY device_id, pool <= {n} ORDER BY score DESC) END AS rank_in_{n}"
    for n in (22, 50, 100))
_THREE_USERS = """three_v AS (SELECT * FROM (VALUES
  ('a', 'Andhra Pradesh', ['Politics', 'Technology', 'Business', 'National']),
  ('b', 'Karnataka', ['Technology', 'Business', 'Politics', 'National']),
  ('c', 'Bihar', ['National', 'Politics', 'Technology', 'Business'])) u(device_id, user_state, category_order))"""


@query("counterfactual", "WITH " + SQ.PUBLIC_SQL + ", " + _THREE_USERS + f""",
p_v AS (SELECT *, row_number() OVER (ORDER BY base DESC, card_id) AS pool FROM scored_v),
s_v AS (SELECT device_id, card_id, pool, round(base + ({SQ.location('state', 'district', 'user_state', 'NULL')}
  + {SQ.interest('category', 'category_order')}) * 0.15, 6) AS score FROM p_v CROSS JOIN three_v)
SELECT device_id, card_id, score, {_POOLS}, rank() OVER (PARTITION BY device_id ORDER BY score DESC) AS rank_in_all FROM s_v""")
def counterfactual(spark, folder):
    """The same cards ranked for three readers within pools of 22, 50, 100 and all."""
    users = spark.createDataFrame([
        ("a", "Andhra Pradesh", None, ["Politics", "Technology", "Business", "National"]),
        ("b", "Karnataka", None, ["Technology", "Business", "Politics", "National"]),
        ("c", "Bihar", None, ["National", "Politics", "Technology", "Business"]),
    ], "device_id string, user_state string, user_district string, category_order array<string>")
    cards = _ranked(spark, folder).withColumn("base_score", F.round("base_score", 2))
    cards = positions(cards.select("card_id", "category", "state", "district", "base_score"),
                      [F.desc("base_score"), F.col("card_id")], "pool_rank")
    out = R.counterfactual(cards, users)
    ranks = [F.col(f"rank_in_{n}").cast("bigint").alias(f"rank_in_{n}") for n in ("22", "50", "100", "all")]
    return out.select("device_id", "card_id", F.col("final_feed_score").alias("score"), *ranks)


@query("coverage_select", "WITH " + SQ.PUBLISHED_SQL + f""",
k AS (SELECT card_id, base, CASE WHEN card_id % 5 = 0 THEN 'State' WHEN card_id % 17 = 0 THEN 'Education' ELSE category END AS cat,
  lower(coalesce(state, '')) AS st FROM scored_v),
b AS (SELECT *, CASE WHEN cat = 'State' AND st IN {Q.in_list([s.lower() for s in K.STATES])} THEN 'state:' || st
  WHEN cat IN {Q.in_list(K.PRIMARY_CATEGORIES)} THEN 'category:' || cat ELSE 'misc' END AS bucket FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY base DESC, card_id) AS n FROM b)
SELECT card_id, bucket, CAST(n AS BIGINT) AS bucket_rank FROM r
WHERE n <= CASE WHEN starts_with(bucket, 'state:') THEN 15 WHEN bucket = 'misc' THEN 10 ELSE 50 END""")
def coverage_select(spark, folder):
    return _selected(spark, folder).select("card_id", "bucket", F.col("bucket_rank").cast("bigint").alias("bucket_rank"))


def _selected(spark, folder):
    out = R.rescore(V.cards(spark, folder), V.card_sources(spark, folder), V.AS_OF)
    base = S.decayed_base(F.col("importance_base"), F.col("urgency_score"), F.col("freshness_score"), F.col("verification_score"))
    cat = F.when(F.col("card_id") % 5 == 0, "State").when(F.col("card_id") % 17 == 0, "Education").otherwise(F.col("category"))
    clusters = out.select("card_id", F.col("card_id").alias("cluster_id"), cat.alias("category"), "state",
                          F.round(F.round(base, 10), 2).alias("importance_score"))
    return R.coverage_select(clusters)


@query("interleave", "WITH " + V.CARDS_SQL + """,
p AS (SELECT card_id, 'primary' AS pool, row_number() OVER (ORDER BY priority_score DESC, card_id) AS i FROM cards_v WHERE card_id % 7 <> 0),
s AS (SELECT card_id, 'second' AS pool, row_number() OVER (ORDER BY priority_score DESC, card_id) AS i FROM cards_v WHERE card_id % 7 = 0),
n AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM s) AS ns),
x AS (SELECT card_id, pool, i, i::DOUBLE AS slot FROM p UNION ALL
  SELECT card_id, pool, i, least(i * greatest(1, np // greatest(1, ns)), np + i) + 0.5 FROM s, n)
SELECT card_id, pool, CAST(row_number() OVER (ORDER BY slot, i) AS BIGINT) AS position FROM x""")
def interleave(spark, folder):
    cards = V.cards(spark, folder).select("card_id", "priority_score")
    out = R.interleave(cards.filter("card_id % 7 <> 0"), cards.filter("card_id % 7 = 0"), "priority_score", "card_id")
    return out.select("card_id", "pool", F.col("position").cast("bigint").alias("position"))


@query("latest_per_source", "WITH " + V.ARTICLES_SQL + """
SELECT id, source_id FROM articles_v WHERE source_id = 'src3' ORDER BY ingested_at DESC, id DESC LIMIT 25""")
def latest_per_source(spark, folder):
    arts = V.articles(spark, folder).withColumnRenamed("source_id", "source").withColumnRenamed("ingested_at", "fetched_at")
    return R.latest(arts, 25, "src3").select("id", F.col("source").alias("source_id"))


@query("cap_per_feed", "WITH " + V.ARTICLES_SQL + """
SELECT id, source_id FROM articles_v QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY ingested_at, id) <= 15""")
def cap_per_feed(spark, folder):
    return R.cap_per_group(V.articles(spark, folder), "source_id", ["ingested_at", "id"], 15).select("id", "source_id")


@query("first_per_headline", "WITH " + V.ARTICLES_SQL + """
SELECT headline_key, min(id) AS id FROM (SELECT id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS headline_key FROM articles_v) GROUP BY 1""")
def first_per_headline(spark, folder):
    arts = V.articles(spark, folder).select("id", text.headline_key("title").alias("headline_key"))
    return R.first_per(arts, "headline_key", ["id"]).select("headline_key", "id")


@query("first_citation_per_source", "WITH " + V.CARD_SOURCES_SQL + """
SELECT cluster_id, source_id, arg_min(article_id, (c.card_id, ord)) AS article_id
FROM card_sources_v x JOIN cards_v c USING (card_id) GROUP BY 1, 2""")
def first_citation_per_source(spark, folder):
    cites = V.card_sources(spark, folder).join(V.cards(spark, folder).select("card_id", "cluster_id"), "card_id")
    rows = cites.withColumn("pos", F.struct("card_id", "ord"))
    return R.card_sources(rows, "cluster_id", "pos").select("cluster_id", "source_id", "article_id")


# --- client views -------------------------------------------------------------------

_TS = "coalesce(published_at, created_at)"
_HOURS = f"(epoch_us(TIMESTAMP '{V.AS_OF}') - epoch_us({_TS})) / 3600000000.0"
_RECENCY = "CASE " + " ".join(f"WHEN {_HOURS} <= {h} THEN {p}" for h, p in K.RECENCY_POINTS) + " ELSE 0 END"
_PRIOS = ["Science", "World", "Business"]


def _tier_sql():
    index = {}
    for i, c in enumerate(_PRIOS):
        index[c.lower()] = i
        for s in K.CLIENT_SYNONYMS[c.lower()]:
            index.setdefault(s, i)
    out = {}
    for cat in {c.lower() for c in K.PRIMARY_CATEGORIES}:
        via = [index[s] for s in K.CLIENT_SYNONYMS.get(cat, []) if s in index]
        out[cat] = index.get(cat, via[0] if via else 999)
    points = {0: 35, 1: 25, 2: 15, 3: 10}
    return "CASE lower(category) " + " ".join(f"WHEN {Q.lit(c)} THEN {points.get(t, 0)}" for c, t in sorted(out.items())) + " ELSE 0 END"


_COMPOSITE = f"""round((CASE WHEN importance = 0 THEN 75.0 ELSE importance END) * 2.2 + ({_RECENCY}) * 1.6
  + (CASE WHEN urgency = 0 THEN 50.0 ELSE urgency END) * 0.9 + trust * 0.6 + (CASE WHEN base = 0 THEN 70.0 ELSE base END) * 0.4
  + ({_tier_sql()}) + CASE WHEN lower(coalesce(state, '')) = 'goa' THEN CASE WHEN {_HOURS} <= 24 THEN 250 ELSE 150 END ELSE 0 END, 6)"""


@query("client_rank", "WITH " + SQ.PUBLIC_SQL + f" SELECT card_id, {_COMPOSITE} AS composite FROM scored_v")
def client_rank(spark, folder):
    return _ranked(spark, folder).select("card_id", R.composite_score(V.AS_OF, _PRIOS, "Goa", "state").alias("composite"))


@query("client_order", "WITH " + SQ.PUBLIC_SQL + f""",
m AS (SELECT *, {_COMPOSITE} AS composite, CASE WHEN lower(trim(coalesce(state, ''))) = 'goa' THEN 100
  WHEN contains(lower(coalesce(headline, '') || ' ' || coalesce(summary, '')), 'goa') THEN 80 ELSE 0 END AS match FROM scored_v)
SELECT card_id, match, composite, row_number() OVER (ORDER BY match DESC, composite DESC, {_TS} DESC NULLS LAST, card_id) AS place FROM m""")
def client_order(spark, folder):
    """The state tab: the reader's state first, then what names it, then the rest, each by score."""
    return R.client_order(_ranked(spark, folder), V.AS_OF, _PRIOS, "Goa", "state").select("card_id", "match", "composite", "place")


_TOK = r"list_filter(regexp_split_to_array(regexp_replace(lower(headline), '[^a-z0-9 ]', '', 'g'), '\s+'), lambda w: length(w) > 3)"


@query("brief", "WITH RECURSIVE " + SQ.PUBLIC_SQL + f""",
p_v AS (SELECT category, card_id, {_TOK} AS tok, row_number() OVER (PARTITION BY category ORDER BY
  urgency * 1.5 + (CASE WHEN importance = 0 THEN 85.0 ELSE importance END) DESC, card_id) AS n FROM scored_v),
walk AS (SELECT category, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[]) AS seen FROM p_v GROUP BY 1
  UNION ALL
  SELECT w.category, p.n,
    CASE WHEN len(list_filter(p.tok, lambda t: list_contains(w.seen, t))) < 3 THEN list_append(w.ids, p.card_id) ELSE w.ids END,
    CASE WHEN len(list_filter(p.tok, lambda t: list_contains(w.seen, t))) < 3 THEN list_concat(w.seen, p.tok) ELSE w.seen END
  FROM walk w JOIN p_v p ON p.category = w.category AND p.n = w.n + 1 WHERE len(w.ids) < 4),
last_v AS (SELECT category, arg_max(ids, n) AS ids FROM walk GROUP BY 1)
SELECT category, unnest(ids) AS card_id, unnest(range(len(ids))) AS position FROM last_v""")
def brief(spark, folder):
    return R.brief(_ranked(spark, folder), "category", 4).select(
        "category", "card_id", F.col("position").cast("bigint").alias("position"))


@query("sections", "WITH " + SQ.PUBLIC_SQL + f""",
r_v AS (SELECT *, lower(trim(headline)) AS head, row_number() OVER (ORDER BY {_FEED_ORDER_SQL}) AS rank FROM scored_v),
top_v AS (SELECT card_id, head, CASE WHEN rank = 1 THEN 'lead' ELSE 'pair' END AS section FROM r_v WHERE rank <= 3),
rest_v AS (SELECT * FROM r_v WHERE head NOT IN (SELECT head FROM top_v)),
pool_v AS (SELECT *, CASE WHEN lower(coalesce(state, '')) = 'kerala' OR contains(head, 'kerala') THEN 0
  WHEN lower(category) = 'state' THEN 1 END AS lev FROM rest_v),
desk_v AS (SELECT * FROM pool_v WHERE lev = (SELECT min(lev) FROM pool_v) ORDER BY rank LIMIT 3),
stream_v AS (SELECT card_id FROM rest_v WHERE head <> '' AND head NOT IN (SELECT head FROM desk_v)
  QUALIFY row_number() OVER (PARTITION BY head ORDER BY rank) = 1)
SELECT card_id, section FROM top_v UNION ALL SELECT card_id, 'desk' FROM desk_v UNION ALL SELECT card_id, 'stream' FROM stream_v""")
def sections(spark, folder):
    order = [F.desc("final_feed_score"), R.epoch("published_at").desc(), R.epoch("created_at").desc(), F.desc("card_id")]
    ranked = positions(_ranked(spark, folder).select(
        "card_id", "headline", "state", "category", "final_feed_score", "published_at", "created_at"), order, "rank")
    return R.sections(ranked, "Kerala").select("card_id", "section")


@query("category_tab", "WITH " + V.CARDS_SQL
       + " SELECT card_id FROM cards_v WHERE lower(category) IN ('world', 'international', 'global')")
def category_tab(spark, folder):
    return R.tab_cards(V.cards(spark, folder), "International").select("card_id")


@query("category_tab_fallback", "WITH " + V.CARDS_SQL
       + " SELECT card_id FROM cards_v WHERE contains(lower(headline || ' ' || summary), 'cyclone')")
def category_tab_fallback(spark, folder):
    """No card has this category, so the tab falls back to the text."""
    return R.tab_cards(V.cards(spark, folder), "Cyclone").select("card_id")


@query("state_tab", "WITH " + V.CARDS_SQL + """
SELECT card_id FROM cards_v WHERE lower(coalesce(state, '')) = 'goa' OR contains(lower(headline), 'goa')
  OR lower(category) IN ('state', 'regional')""")
def state_tab(spark, folder):
    return R.tab_cards(V.cards(spark, folder), "state", state="Goa").select("card_id")


@query("for_you_tab", "WITH " + V.CARDS_SQL + """
SELECT card_id FROM cards_v WHERE lower(coalesce(state, '')) = 'goa' OR contains(lower(headline), 'goa')
  OR lower(category) IN ('science', 'space', 'health', 'medical', 'state', 'regional')""")
def for_you_tab(spark, folder):
    return R.tab_cards(V.cards(spark, folder), "for_you", ["Science", "Health"], "Goa").select("card_id")


@query("backfill", "WITH " + V.CARDS_SQL + """,
p AS (SELECT card_id FROM cards_v WHERE priority_score = 10 AND state = 'Goa'),
g AS (SELECT card_id, row_number() OVER (ORDER BY card_id) AS n FROM cards_v WHERE card_id NOT IN (SELECT card_id FROM p))
SELECT card_id FROM p UNION ALL SELECT card_id FROM g WHERE n <= 35 - (SELECT count(*) FROM p)""")
def backfill(spark, folder):
    cards = V.cards(spark, folder).select("card_id", "priority_score", "state")
    return R.backfill(cards.filter("priority_score = 10 and state = 'Goa'"), cards, 35).select("card_id")


@query("trending", "WITH " + V.CARDS_SQL + rf""",
w AS (SELECT category, unnest(regexp_extract_all(headline || ' ' || summary, '[\p{{L}}\p{{N}}_]+')) AS topic FROM cards_v),
c AS (SELECT category, topic, count(*) AS mentions FROM w WHERE regexp_matches(topic, '^[A-Z][a-zA-Z0-9]{{2,}}$')
  AND lower(topic) NOT IN {Q.in_list(K.TREND_STOPWORDS)} GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT category, topic, mentions FROM c QUALIFY row_number() OVER (PARTITION BY category ORDER BY mentions DESC, topic) <= 8""")
def trending(spark, folder):
    """Eight topics per category over all cards."""
    return R.trending(V.cards(spark, folder), None, pool=None, by=("category",))


@query("feed_stats", "WITH " + V.CARD_SOURCES_SQL + rf""",
n AS (SELECT card_id, count(*) AS n FROM card_sources_v GROUP BY 1),
w AS (SELECT c.*, n.n, len(list_filter(regexp_split_to_array(summary, '\s+'), lambda x: x <> '')) AS words FROM cards_v c JOIN n USING (card_id))
SELECT category, count(*) AS cards, min(words) AS min_words, max(words) AS max_words, round(avg(words), 4) AS avg_words,
  round(avg(n), 4) AS avg_sources, count(*) FILTER (district IS NOT NULL) AS local_cards FROM w GROUP BY 1""")
def feed_stats(spark, folder):
    counts = V.card_sources(spark, folder).groupBy("card_id").agg(F.count(F.lit(1)).alias("n_sources"))
    out = R.feed_stats(V.cards(spark, folder).join(counts, "card_id"))
    return out.withColumn("avg_words", F.round("avg_words", 4)).withColumn("avg_sources", F.round("avg_sources", 4))


# --- filters that belong to feeds ---------------------------------------------------------

@query("public_cards", "WITH " + V.CARDS_SQL + f" SELECT card_id FROM cards_v WHERE {SQ.PUBLIC_WHERE}")
def public_cards(spark, folder):
    return P.public_cards(V.cards(spark, folder)).select("card_id")
