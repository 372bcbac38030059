"""Ranked feeds for many readers, and the client-side views of them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions.dates import age_minutes
from storyloom.functions.labels import categories_match, literal_list_map, literal_map
from storyloom.functions.text import strip, text_or_empty, token_count
from storyloom.operators import scoring as S
from storyloom.operators.filters import public_cards


def epoch(ts) -> Column:
    """Seconds since the epoch, 0 for NULL."""
    return F.coalesce(F.unix_micros(ts) / 1000000.0, F.lit(0.0))


def card_trust(cards: DataFrame, citations: DataFrame) -> DataFrame:
    """Cards with trust score and citation counts; a stored score above 0 wins.

    The feed scores names and tiers only, so addresses are left out.
    """
    tier1 = citations.groupBy("card_id").agg(
        F.count_if(F.col("trust_tier").isin("1", "Tier 1")).alias("tier1_count"))
    scores = S.trust_scores(citations.withColumn("url", F.lit(""))).select(
        "card_id", F.col("verification_score").alias("_trust"), "source_count")
    joined = cards.join(scores, "card_id", "left").join(tier1, "card_id", "left")
    computed = F.coalesce("_trust", F.lit(S.NO_SOURCES_TRUST))
    if "verification_score" in cards.columns:
        stored = F.col("verification_score")
        computed = F.when(F.coalesce(stored, F.lit(0.0)) > 0, stored).otherwise(computed)
    return (
        joined.withColumn("verification_score", computed)
        .withColumn("source_count", F.coalesce("source_count", F.lit(0)).cast("bigint"))
        .withColumn("tier1_count", F.coalesce("tier1_count", F.lit(0)).cast("bigint"))
        .drop("_trust")
    )


def scored_cards(cards: DataFrame, citations: DataFrame, as_of) -> DataFrame:
    """All reader-independent scores of the public cards."""
    base = card_trust(S.with_story_scores(public_cards(cards), as_of, lifestyle_cap=True), citations)
    return base.withColumn(
        "importance_score",
        S.effective_importance(F.col("importance_base"), F.col("urgency_score"), F.col("freshness_score")),
    ).withColumn(
        "base_score",
        S.decayed_base(F.col("importance_base"), F.col("urgency_score"), F.col("freshness_score"),
                       F.col("verification_score")),
    )


def best_per_cluster(cards: DataFrame, score="final_feed_score", by=("cluster_id",), ident="card_id") -> DataFrame:
    """The best-scored card of each cluster, the smaller id on ties."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), ident)
    return cards.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


FEED_ORDER = ["final_feed_score", "published_s", "created_s", "card_id"]


def _leading(cards: DataFrame, keys, need: int, score: str) -> DataFrame:
    """The first ``need`` clusters per key, each by its first card in feed order.

    Both rankings are bounded by a literal, so Spark prunes them before the
    shuffle and no task receives a whole category.
    """
    order = [F.desc(score), F.desc("published_s"), F.desc("created_s"), F.desc("card_id")]
    one = Window.partitionBy(*keys, "cluster_id").orderBy(*order)
    first = cards.withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    top = Window.partitionBy(*keys).orderBy(*order)
    return first.withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= need).drop("_n")


def user_feeds(scored: DataFrame, users: DataFrame, offset: int = 0, limit: int = 10) -> DataFrame:
    """One page of the ranked feed for every reader.

    A reader's place decides the location points of a card, the category order
    the rest.  Cards are put on shelves: a district, a state, no place, all.
    For each level of location points there is a shelf whose other cards are
    worth at least that level to the reader; there, within a category, a card
    behind ``need`` other clusters can never be shown.  Places are joined with
    their shelves by key, readers with the leading cards of their place; cards
    and readers are never crossed.  A cluster shows its first card in feed order.
    """
    need = offset + limit

    def clean(c):
        return F.lower(strip(text_or_empty(F.col(c))))

    base = F.bround(F.round("base_score", 10), 2)
    cards = scored.select(
        "card_id", F.coalesce("cluster_id", "card_id").alias("cluster_id"), "category",
        clean("state").alias("state"), clean("district").alias("district"), base.alias("base_score"),
        epoch("published_at").alias("published_s"), epoch("created_at").alias("created_s"),
    )

    here, there = F.col("state") != "", F.col("district") != ""
    shelf = F.array_compact(F.array(
        F.when(there, F.concat(F.lit("district:"), "district")),
        F.when(here, F.concat(F.lit("state:"), "state")),
        F.when(~here & ~there, F.lit("no place")), F.when(~here, F.lit("no state")),
        F.when(~there, F.lit("no district")), F.lit("all"),
    ))
    shelves = _leading(cards.withColumn("shelf", F.explode(shelf)), ("shelf", "category"), need, "base_score")

    readers = users.select(
        "device_id", clean("user_state").alias("user_state"), clean("user_district").alias("user_district"),
        S.clean_order(F.coalesce("category_order", F.array().cast("array<string>"))).alias("wishes"))
    has_state, has_district = F.col("user_state") != "", F.col("user_district") != ""
    visited = F.array_compact(F.array(
        F.when(has_district, F.concat(F.lit("district:"), "user_district")),
        F.when(has_state, F.concat(F.lit("state:"), "user_state")),
        F.when(has_state & has_district, F.lit("no place")).when(has_state, F.lit("no state"))
        .when(has_district, F.lit("no district")),
        F.lit("all"),
    ))
    places = readers.select("user_state", "user_district").distinct().withColumn("shelf", F.explode(visited))
    place = ["user_state", "user_district"]
    local = S.location_score(
        F.col("category"), F.col("state"), F.col("district"), F.col("user_state"), F.col("user_district"))
    pool = places.join(shelves, "shelf").drop("shelf").dropDuplicates([*place, "card_id"])
    pool = pool.withColumn("location", local).withColumn(
        "local_score", F.round(F.col("base_score") + F.col("location") * K.WEIGHT_RELEVANCE, 6))
    pool = _leading(pool, (*place, "category"), need, "local_score")

    pool = pool.withColumn("wish", clean("category"))
    # readers are dealt out before each meets the cards of its place
    seen = readers.repartition("device_id").join(pool, place).withColumn(
        "relevance", F.bround(F.col("location") + S.ranked_interest(F.col("wish"), F.col("wishes")), 2))
    total = F.col("base_score") + F.col("relevance") * K.WEIGHT_RELEVANCE
    seen = seen.select(
        "device_id", "card_id", "cluster_id", "relevance", "published_s", "created_s",
        F.bround(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 10), 2).alias("final_feed_score"))
    best = _leading(seen, ("device_id",), need, "final_feed_score")
    w = Window.partitionBy("device_id").orderBy(*[F.desc(c) for c in FEED_ORDER])
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") > offset).select(
        "device_id", "rank", "card_id", "cluster_id", "relevance", "final_feed_score")


def explain_cards(cards: DataFrame) -> DataFrame:
    """Adds the reason sentence and the score breakdown to scored cards."""
    return cards.withColumn("priority_reason", S.reason(
        F.col("impact_evidence"), F.col("importance_score"), F.col("urgency_score"), F.col("freshness_score"),
        F.col("personal_relevance_score"), F.col("verification_score"), F.col("source_count"),
        F.col("tier1_count"), F.lit(False),
    )).withColumn("breakdown", S.breakdown(
        F.col("importance_score"), F.col("urgency_score"), F.col("freshness_score"),
        F.col("personal_relevance_score"), F.col("verification_score")))


def rescore(cards: DataFrame, citations: DataFrame, as_of) -> DataFrame:
    """Every published card through all scores, without a reader."""
    live = cards.filter(F.col("verified_status") == "published")
    base = card_trust(S.with_story_scores(live, as_of), citations)
    none = F.lit(None).cast("string")
    rel = S.relevance(F.col("category"), F.col("state"), none, none, none, F.array().cast("array<string>"))
    out = base.withColumn("personal_relevance_score", rel).withColumn("final_feed_score", S.final_score(
        F.col("importance_base"), F.col("urgency_score"), F.col("freshness_score"),
        F.col("personal_relevance_score"), F.col("verification_score"),
    )).withColumn("importance_score", S.effective_importance(
        F.col("importance_base"), F.col("urgency_score"), F.col("freshness_score")))
    return explain_cards(out)


def state_priority(state, headline, district, user_state) -> Column:
    """2 for the reader's state, 1 when the text names it, else 0."""
    want = F.lower(strip(text_or_empty(user_state)))
    text = F.lower(F.concat_ws(" ", text_or_empty(headline), text_or_empty(district)))
    return (
        F.when((want != "") & (F.lower(strip(text_or_empty(state))) == want), 2)
        .when((want != "") & F.contains(text, want), 1).otherwise(0)
    )


def order_feed(cards: DataFrame, user_state: str | None = None, state_tab: bool = False) -> DataFrame:
    """Feed order; the state tab puts the reader's state first."""
    first = (
        state_priority(F.col("state"), F.col("headline"), F.col("district"), F.lit(user_state or ""))
        if state_tab else F.lit(0)
    )
    return cards.orderBy(
        first.desc(), F.desc("final_feed_score"), epoch("published_at").desc(), epoch("created_at").desc(),
        F.desc("card_id"))


def page(cards: DataFrame, offset: int, limit: int, order) -> DataFrame:
    """Rows offset+1 .. offset+limit of the order, with the total.

    The top is taken with an ordered limit, so no task sorts the whole table.
    """
    top = cards.orderBy(*order).limit(offset + limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).filter(F.col("rank") > offset)
    total = cards.groupBy().agg(F.count(F.lit(1)).alias("total")).withColumn("_one", F.lit(1))
    return ranked.withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")


def coverage_select(clusters: DataFrame, per_category=50, misc=10, per_state=15) -> DataFrame:
    """Candidates by importance: so many per primary category, state and the rest."""
    cat = F.coalesce(strip(F.col("category")), F.lit("National"))
    state = F.lower(strip(text_or_empty(F.col("state"))))
    is_state = (cat == "State") & state.isin([s.lower() for s in K.STATES])
    bucket = (
        F.when(is_state, F.concat(F.lit("state:"), state))
        .when(cat.isin(K.PRIMARY_CATEGORIES), F.concat(F.lit("category:"), cat))
        .otherwise(F.lit("misc"))
    )
    cap = (
        F.when(F.startswith("bucket", F.lit("state:")), per_state)
        .when(F.col("bucket") == "misc", misc).otherwise(per_category)
    )
    w = Window.partitionBy("bucket").orderBy(F.desc("importance_score"), "cluster_id")
    return (
        clusters.withColumn("bucket", bucket).withColumn("bucket_rank", F.row_number().over(w))
        # a literal bound first lets Spark prune inside each partition
        .filter(F.col("bucket_rank") <= max(per_category, misc, per_state))
        .filter(F.col("bucket_rank") <= cap)
    )


def interleave(primary: DataFrame, second: DataFrame, order: str, ident: str) -> DataFrame:
    """One ranked list: after every ``ratio`` primary rows one of the second pool.

    ``ratio`` is |primary| // |second|, at least 1; second rows left over come last.
    """
    from storyloom.operators.ranks import positions

    def ranked(df, tag):
        return positions(df, [F.desc(order), F.col(ident)], "_i").withColumn("pool", F.lit(tag))

    both = ranked(primary, "primary").unionByName(ranked(second, "second"), True)
    counts = both.groupBy().agg(
        F.count_if(F.col("pool") == "primary").alias("_np"), F.count_if(F.col("pool") == "second").alias("_ns")
    ).withColumn("_one", F.lit(1))
    ratio = F.greatest(F.lit(1), F.floor(F.col("_np") / F.greatest(F.col("_ns"), F.lit(1))))
    slot = F.when(F.col("pool") == "primary", F.col("_i").cast("double")).otherwise(
        F.least(F.col("_i") * ratio, F.col("_np") + F.col("_i")).cast("double") + 0.5)
    placed = both.withColumn("_one", F.lit(1)).join(counts, "_one").withColumn("_slot", slot)
    return positions(placed, [F.col("_slot"), F.col("_i")], "position").drop("_one", "_np", "_ns", "_slot", "_i")


def latest(df: DataFrame, n: int, source: str | None = None, order=("fetched_at", "id")) -> DataFrame:
    """The newest n rows, of one source if given."""
    out = df if source is None else df.filter(F.col("source") == source)
    return out.orderBy(*[F.desc(c) for c in order]).limit(n)


def cap_per_group(df: DataFrame, key: str, order, n: int) -> DataFrame:
    """First n rows of each group."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def first_per(df: DataFrame, key, order) -> DataFrame:
    """First row of each key in the given order."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    ).select(*keys, "_r.*")


def rank_in_pools(df: DataFrame, score: str, pool_order: str, pools=(22, 50, 100), by=()) -> DataFrame:
    """Rank of each row by score within the first n rows of another order, and in all.

    ``pool_order`` is a position column; rows outside a pool have NULL there.
    """
    from storyloom.operators.ranks import ranks

    out = ranks(df, score, "rank_in_all", by)
    for n in pools:
        inside = F.col(pool_order) <= n
        # rows outside the pool are spread out, only the n inside have to meet
        spread = F.when(inside, F.lit(-1)).otherwise(F.pmod(F.xxhash64(pool_order), F.lit(4096)))
        w = Window.partitionBy(*by, spread).orderBy(F.desc(score))
        out = out.withColumn(f"rank_in_{n}", F.when(inside, F.rank().over(w)))
    return out


def order_violations(df: DataFrame, rank: str, score: str, by=()) -> DataFrame:
    """Rows whose successor in the group scores higher; a group of any size is numbered by ranges and joined with itself."""
    from storyloom.operators.ranks import positions

    placed = positions(df, [*[F.col(c) for c in by], F.col(rank)], "_at")
    following = placed.select((F.col("_at") - 1).alias("_before"), F.struct(*by).alias("_group"), F.col(score).alias("next_score"))
    return placed.join(following, (F.col("_at") == F.col("_before")) & F.struct(*by).eqNullSafe(F.col("_group"))) \
        .filter(F.col("next_score") > F.col(score)).drop("_at", "_before", "_group")


def card_sources(articles: DataFrame, key="card_id", order="ord") -> DataFrame:
    """One citation per card and source: the first article of the source."""
    return first_per(articles, [key, "source_id"], [order])


# --- client views --------------------------------------------------------------

def recency_points(ts, as_of) -> Column:
    hours = age_minutes(ts, as_of) / 60.0
    out = F.when(ts.isNull(), F.lit(20))
    for limit, points in K.RECENCY_POINTS:
        out = out.when(hours <= limit, F.lit(points))
    return out.otherwise(F.lit(0))


def state_match(state, headline, summary, target: str, keywords=None) -> Column:
    """100 for the reader's state, 80 when a keyword of it is in the text."""
    want = target.strip().lower()
    own = F.lower(strip(text_or_empty(state)))
    same = own == want
    if "delhi" in want:
        same = same | F.contains(own, F.lit("delhi"))
    text = F.lower(F.concat_ws(" ", text_or_empty(headline), text_or_empty(summary)))
    named = F.lit(False)
    for kw in keywords or [want]:
        named = named | F.contains(text, F.lit(kw))
    return F.when(F.lit(want == ""), 0).when(same, 100).when(named, 80).otherwise(0)


def priority_tier(category, priorities) -> Column:
    """Index of a category, or of a synonym, in the reader's ordered list; else 999."""
    index: dict[str, int] = {}
    for i, cat in enumerate(priorities):
        low = cat.strip().lower()
        index[low] = i
        for syn in K.CLIENT_SYNONYMS.get(low, []):
            index.setdefault(syn, i)
    low = F.lower(strip(text_or_empty(category)))
    if not index:
        return F.lit(999)
    table = literal_map(index)
    syns = F.coalesce(F.try_element_at(literal_list_map(K.CLIENT_SYNONYMS), low), F.array().cast("array<string>"))
    via = F.get(F.filter(F.transform(syns, lambda s: F.try_element_at(table, s)), lambda i: i.isNotNull()), F.lit(0))
    return F.coalesce(F.try_element_at(table, low), via, F.lit(999))


def _or_default(name: str, default: float) -> Column:
    """A score, or its default where missing or zero."""
    return F.when(F.coalesce(F.col(name), F.lit(0.0)) == 0, F.lit(default)).otherwise(F.col(name))


def composite_score(as_of, priorities, state: str, tab: str, keywords=None) -> Column:
    """Client ranking score of a card."""
    ts = F.coalesce("published_at", "created_at")
    tier = priority_tier(F.col("category"), priorities)
    points = F.lit(0)
    for i, p in reversed(list(enumerate(K.PRIORITY_POINTS))):
        points = F.when(tier == i, F.lit(p)).otherwise(points)
    match = state_match(F.col("state"), F.col("headline"), F.col("summary"), state, keywords)
    today = F.coalesce(age_minutes(ts, as_of) <= 1440, F.lit(False))
    # keyword matches score 80 and so never reach the points meant for 60
    place = {"state": (250, 150, 100), "for_you": (35, 20, 15)}.get(tab)
    state_points = F.lit(0)
    if place:
        state_points = (
            F.when((match == 100) & today, place[0]).when(match == 100, place[1])
            .when(match == 60, place[2]).otherwise(0)
        )
    return F.round(
        _or_default("importance_score", 75.0) * 2.2
        + recency_points(ts, as_of) * 1.6
        + _or_default("urgency_score", 50.0) * 0.9
        + _or_default("verification_score", 80.0) * 0.6
        + _or_default("final_feed_score", 70.0) * 0.4
        + points + state_points,
        6,
    )


def client_order(cards: DataFrame, as_of, priorities, state: str, tab: str, keywords=None) -> DataFrame:
    """Cards with place (from 1), match and composite, in the order of a client tab.

    The state tab shows what matches the reader's state first; then the composite score decides, then the newer time, then
    the id. Places come from ranges of the order.
    """
    match = state_match(F.col("state"), F.col("headline"), F.col("summary"), state, keywords) if tab == "state" else F.lit(0)
    scored = cards.withColumn("match", match).withColumn("composite", composite_score(as_of, priorities, state, tab, keywords))
    from storyloom.operators.ranks import positions
    from storyloom.session import Workspace

    newest = F.coalesce("published_at", "created_at")
    # saved, as dealing into ranges looks at the order before it deals
    scored = Workspace(cards.sparkSession, "client").save(scored, "scored")
    return positions(scored, [F.desc("match"), F.desc("composite"), F.desc_nulls_last(newest), F.asc("card_id")], "place")


def tab_cards(cards: DataFrame, tab: str, interests=(), state: str = "", backfill: int = 35) -> DataFrame:
    """Cards of a client tab, with its fallbacks.

    A category tab without cards falls back to a text search for its name, and
    any empty tab to all cards.  "for_you" keeps the reader's state and
    interests and is filled up to ``backfill`` rows.  Fallback levels are
    resolved by one small aggregation.
    """
    want = state.strip().lower()
    own = F.lower(strip(text_or_empty(F.col("state"))))
    head = F.lower(text_or_empty(F.col("headline")))
    named = F.contains(head, F.lit(want)) if want else F.lit(False)
    low_tab = (tab or "for_you").lower()
    everything = F.lit(0)
    if low_tab == "state":
        regional = F.lower(text_or_empty(F.col("category"))).isin("state", "regional")
        mine = (own == want) | named if want else F.lit(False)
        level = F.when(mine | regional, 0)
    elif low_tab in ("all", "saved"):
        level = everything
    elif low_tab == "for_you":
        if not interests:
            level = everything
        else:
            near = ((own == want) | named) if want else F.lit(False)
            if "delhi" in want:
                near = near | F.contains(own, F.lit("delhi"))
            liked = categories_match(F.col("category"), F.lit("state"))
            for pref in interests:
                liked = liked | categories_match(F.col("category"), F.lit(pref))
            preferred = near | liked
            tagged = cards.withColumn("_level", F.when(preferred, 0).otherwise(1))
            return _backfill(tagged, backfill)
    else:
        text = F.lower(F.concat_ws(" ", text_or_empty(F.col("headline")), text_or_empty(F.col("summary"))))
        level = F.when(categories_match(F.col("category"), F.lit(tab)), 0).when(F.contains(text, F.lit(low_tab)), 1)
    tagged = cards.withColumn("_level", F.coalesce(level, F.lit(2)))
    best = tagged.groupBy().agg(F.min("_level").alias("_level"))
    return tagged.join(best, "_level").drop("_level")


def _backfill(tagged: DataFrame, least: int) -> DataFrame:
    """All level-0 rows, and the first level-1 rows up to ``least`` in total."""
    have = tagged.groupBy().agg(F.count_if(F.col("_level") == 0).alias("_have")).withColumn("_one", F.lit(1))
    preferred = tagged.filter("_level = 0")
    rest = tagged.filter("_level = 1").orderBy("card_id").limit(least)
    rest = rest.withColumn("_n", F.row_number().over(Window.orderBy("card_id"))).withColumn("_one", F.lit(1))
    fill = rest.join(have, "_one").filter(F.col("_n") <= least - F.col("_have"))
    return preferred.drop("_level").unionByName(fill.select(*[c for c in tagged.columns if c != "_level"]))


def backfill(preferred: DataFrame, general: DataFrame, least: int = 35) -> DataFrame:
    """Preferred rows, filled up with the first general rows not among them."""
    tagged = preferred.withColumn("_level", F.lit(0)).unionByName(
        general.join(preferred.select("card_id"), "card_id", "left_anti").withColumn("_level", F.lit(1)))
    return _backfill(tagged, least)


def brief(cards: DataFrame, group: str, k: int = 4) -> DataFrame:
    """Per group, up to k headlines that share fewer than three words with those before.

    Cards are taken by urgency and importance.  The words seen only grow, so a
    refused card stays refused and each pick is the best card that still
    passes: k small aggregations, and no group is ever collected.
    """
    score = F.coalesce(_nonzero("urgency_score"), F.lit(80.0)) * 1.5 + F.coalesce(
        _nonzero("importance_score"), F.lit(85.0))
    tokens = F.filter(
        F.split(F.regexp_replace(F.lower(text_or_empty(F.col("headline"))), "[^a-z0-9 ]", ""), r"\s+"),
        lambda w: F.length(w) > 3)
    pool = cards.select(group, "card_id", tokens.alias("tokens"), score.alias("score"))
    best = F.min_by(F.struct("card_id", "tokens"), F.struct(-F.col("score"), F.col("card_id")))
    picked = pool.groupBy(group).agg(best.alias("pick")).select(
        group, F.array("pick.card_id").alias("ids"), F.col("pick.tokens").alias("seen"))
    for _ in range(k - 1):
        hits = F.size(F.filter("tokens", lambda t: F.array_contains("seen", t)))
        left = pool.join(picked, group).filter((hits < 3) & ~F.array_contains("ids", F.col("card_id")))
        nxt = left.groupBy(group).agg(best.alias("pick"))
        picked = picked.join(nxt, group, "left").select(
            group,
            F.when(F.col("pick").isNull(), F.col("ids")).otherwise(
                F.array_append("ids", F.col("pick.card_id"))).alias("ids"),
            F.array_union("seen", F.coalesce("pick.tokens", F.array().cast("array<string>"))).alias("seen"),
        )
    return picked.select(group, F.posexplode("ids").alias("position", "card_id"))


def _nonzero(name: str) -> Column:
    return F.when(F.col(name) != 0, F.col(name))


def sections(cards: DataFrame, state: str, desk: int = 3) -> DataFrame:
    """Split a ranked list (column ``rank``) into lead, pair, state desk and stream.

    Nothing is shown twice: later sections leave out ids and headlines of the
    earlier ones.
    """
    want = state.strip().lower()
    head = F.lower(strip(text_or_empty(F.col("headline"))))
    own = F.lower(strip(text_or_empty(F.col("state"))))
    base = cards.withColumn("_head", head)
    top = base.filter(F.col("rank") <= 3).select(
        "card_id", "_head", F.when(F.col("rank") == 1, "lead").otherwise("pair").alias("section"))
    rest = base.join(top.select("_head"), "_head", "left_anti")
    local = (own == want) | F.contains(head, F.lit(want)) if want else F.lit(False)
    if "delhi" in want:
        local = local | F.contains(own, F.lit("delhi"))
    regional = F.lower(text_or_empty(F.col("category"))) == "state"
    # the desk falls back to regional cards only when no local card is left
    level = F.when(local, 0).when(regional, 1)
    pool = rest.withColumn("_level", level).filter("_level is not null")
    top_desk = pool.orderBy("_level", "rank").limit(desk).select("card_id", "_head", "_level")
    used = top_desk.join(top_desk.groupBy().agg(F.min("_level").alias("_level")), "_level")
    used = used.select("card_id", "_head", F.lit("desk").alias("section"))
    stream = rest.filter("_head <> ''").join(used.select("_head"), "_head", "left_anti")
    stream = first_per(stream.select("_head", "card_id", "rank"), "_head", ["rank"])
    return (
        top.unionByName(used).unionByName(stream.select("card_id", "_head", F.lit("stream").alias("section")))
        .join(cards.select("card_id", "rank"), "card_id").drop("_head")
    )


def trending(cards: DataFrame, order, pool: int = 100, least: int = 2, k: int = 8, by=()) -> DataFrame:
    """Most frequent capitalised words of the first ``pool`` cards (all with None)."""
    top = cards if pool is None else cards.orderBy(*order).limit(pool)
    text = F.concat_ws(" ", text_or_empty(F.col("headline")), text_or_empty(F.col("summary")))
    word = F.explode(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("topic")
    counted = (
        top.select(*by, word).filter(F.col("topic").rlike("^[A-Z][a-zA-Z0-9]{2,}$"))
        .filter(~F.lower("topic").isin(K.TREND_STOPWORDS))
        .groupBy(*by, "topic").agg(F.count(F.lit(1)).alias("mentions")).filter(F.col("mentions") >= least)
    )
    if by:
        return cap_per_group(counted, by[0], [F.desc("mentions"), "topic"], k)
    return counted.orderBy(F.desc("mentions"), "topic").limit(k)


def counterfactual(cards: DataFrame, users: DataFrame, pools=(22, 50, 100)) -> DataFrame:
    """Ranks of the same cards for several readers and pool sizes.

    ``cards`` carry base_score and pool_rank; ``users`` is a short list.
    """
    klass = F.xxhash64("category", "state", "district")
    both = users.withColumn("_one", F.lit(1)).join(
        cards.select("category", "state", "district").distinct().withColumn("_one", F.lit(1)), "_one")
    rel = both.select("device_id", klass.alias("class_id"), S.relevance(
        F.col("category"), F.col("state"), F.col("district"), F.col("user_state"), F.col("user_district"),
        F.col("category_order")).alias("relevance"))
    scored = cards.withColumn("class_id", klass).join(rel, "class_id").withColumn(
        "final_feed_score", F.round(F.col("base_score") + F.col("relevance") * K.WEIGHT_RELEVANCE, 6))
    return rank_in_pools(scored, "final_feed_score", "pool_rank", pools, ("device_id",))


def feed_stats(feed: DataFrame, by=("category",)) -> DataFrame:
    """Summary lengths, sources and local share, per category."""
    words = token_count(F.col("summary"))
    return feed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cards"), F.min(words).alias("min_words"), F.max(words).alias("max_words"),
        F.avg(words).alias("avg_words"), F.avg("n_sources").alias("avg_sources"),
        F.count_if(F.col("district").isNotNull()).alias("local_cards"),
    )
