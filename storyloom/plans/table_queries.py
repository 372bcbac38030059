"""Filters, joins, audits, state changes and table migration."""

from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions import urls
from storyloom.operators import audits as A
from storyloom.operators import feed as R
from storyloom.operators import filters as P
from storyloom.operators import joins as J
from storyloom.operators.ranks import positions
from storyloom.plans import fixtures as V
from storyloom.plans import scoring_sql as SQ
from storyloom.plans import sqltext as Q
from storyloom.plans.registry import query
from storyloom.session import new_folder
from storyloom.sources import articles as SA
from storyloom.sources import tables as ST
from storyloom.sources.snapshots import read_version


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- filters -----------------------------------------------------------------------

@query("validate_required", "WITH " + V.ARTICLES_SQL + """
SELECT id, CASE WHEN id % 10 = 0 THEN 'missing_title' WHEN id % 10 = 1 THEN 'missing_link' WHEN id % 10 = 2 THEN 'missing_source'
  WHEN id % 10 = 3 THEN 'missing_category' WHEN id % 10 = 4 THEN 'invalid_timestamp' ELSE 'valid' END AS reason FROM articles_v""")
def validate_required(spark, folder):
    m = F.col("id") % 10
    rows = V.articles(spark, folder).select(
        "id", F.when(m == 0, " ").otherwise(F.col("title")).alias("title"),
        F.when(m != 1, F.col("url")).alias("link"), F.when(m == 2, "").otherwise(F.col("source_id")).alias("source"),
        F.when(m != 3, F.col("category")).alias("category"),
        F.when(m == 4, "not_a_date").otherwise(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("published_date"))
    return P.validate_required(rows).select("id", "reason")


_LOW = "CASE WHEN id % 6 = 0 THEN title || ' Horoscope today' WHEN id % 6 = 1 THEN title || ' answers today' ELSE title END"


@query("drop_low_value", "WITH " + V.ARTICLES_SQL + f"""
SELECT id, NOT {Q.contains_any('lower(t)', K.LOW_VALUE_LIVE)} AS live_ok FROM (SELECT id, {_LOW} AS t FROM articles_v)
WHERE NOT {Q.contains_any('lower(t)', K.LOW_VALUE_CRAWL)}""")
def drop_low_value(spark, folder):
    m = F.col("id") % 6
    t = F.when(m == 0, F.concat("title", F.lit(" Horoscope today"))).when(m == 1, F.concat("title", F.lit(" answers today"))).otherwise(F.col("title"))
    rows = V.articles(spark, folder).select("id", t.alias("title"))
    live = P.drop_low_value(rows, phrases=K.LOW_VALUE_LIVE).select("id", F.lit(True).alias("live_ok"))
    return P.drop_low_value(rows).join(live, "id", "left").select("id", F.coalesce("live_ok", F.lit(False)).alias("live_ok"))


@query("within_hours", "WITH " + V.ARTICLES_SQL + f"""
SELECT id FROM articles_v WHERE published_at >= TIMESTAMP '{V.AS_OF}' - INTERVAL 72 HOURS AND published_at <= TIMESTAMP '{V.AS_OF}' + INTERVAL 2 HOURS""")
def within_hours(spark, folder):
    return P.within_hours(V.articles(spark, folder), V.AS_OF).select("id")


@query("by_category", "WITH " + V.CARDS_SQL + """
SELECT card_id FROM cards_v WHERE lower(category) IN ('politics', 'political', 'national', 'governance', 'policy', 'india', 'tech', 'technology')""")
def by_category(spark, folder):
    return P.by_category(V.cards(spark, folder), ["politics", "Technology"]).select("card_id")


@query("state_desk", "WITH " + V.CARDS_SQL + " SELECT card_id FROM cards_v WHERE lower(state) = 'goa' OR state IS NULL")
def state_desk(spark, folder):
    return P.state_desk(V.cards(spark, folder), ["state"], " Goa ").select("card_id")


@query("feed_legacy", "WITH " + V.CARDS_SQL + """
SELECT card_id FROM cards_v WHERE verified_status = 'published' AND category IN ('Technology', 'Science', 'Politics', 'World') AND district = 'pune'""")
def feed_legacy(spark, folder):
    return P.feed_legacy(V.cards(spark, folder), ["Technology", "Science", "Politics", "World"], district="pune").select("card_id")


@query("boosted_feed", "WITH " + V.CARDS_SQL + """,
b AS (SELECT card_id, published_at, created_at, priority_score * 3.0 + CASE WHEN district = 'pune' THEN 50.0 ELSE 0.0 END
    + CASE WHEN state = 'Goa' THEN 20.0 ELSE 0.0 END AS boosted_score
  FROM cards_v WHERE verified_status = 'published' AND (district = 'pune' OR district IS NULL) AND (state = 'Goa' OR state IS NULL))
SELECT card_id, boosted_score FROM b ORDER BY boosted_score DESC, published_at DESC NULLS LAST, created_at DESC, card_id DESC LIMIT 20""")
def boosted_feed(spark, folder):
    """Top twenty with the location boost."""
    cards = V.cards(spark, folder).withColumn("objective_score", F.col("priority_score") * 3.0)
    out = P.boosted(cards, "pune", "Goa")
    return out.orderBy(F.desc("boosted_score"), F.desc("published_at"), F.desc("created_at"), F.desc("card_id")).limit(20).select(
        "card_id", "boosted_score")


@query("search", "WITH " + V.CARDS_SQL + " SELECT card_id FROM cards_v WHERE contains(lower(headline), 'ward 4') OR contains(lower(summary), 'ward 4')")
def search(spark, folder):
    return P.search(V.cards(spark, folder), " WARD 4").select("card_id")


@query("by_topic", "WITH " + V.CARDS_SQL + " SELECT card_id FROM cards_v WHERE contains(lower(headline || ' ' || summary), 'treaty')")
def by_topic(spark, folder):
    return P.by_topic(V.cards(spark, folder), "Treaty").select("card_id")


_FAKE = "summary || CASE WHEN card_id % 8 = 0 THEN ' In a significant development' ELSE '' END"


def _faked(spark, folder):
    return V.cards(spark, folder).withColumn("summary", F.concat("summary", F.when(
        F.col("card_id") % 8 == 0, " In a significant development").otherwise("")))


@query("purge_boilerplate", "WITH " + V.CARD_SOURCES_SQL + f"""
SELECT card_id, ord FROM card_sources_v WHERE card_id NOT IN (SELECT card_id FROM (SELECT card_id, {_FAKE} AS summary FROM cards_v)
  WHERE {Q.contains_any('summary', K.PURGE_BOILERPLATE)})""")
def purge_boilerplate(spark, folder):
    _, cites = P.purge_boilerplate(_faked(spark, folder), V.card_sources(spark, folder))
    return cites.select("card_id", "ord")


_GATE = f"""g AS (SELECT doc_id, text, {Q.word_count('text')} AS w, {Q.sentence_count('text')} AS s, {Q.fk_grade('text')} AS g,
  array_to_string(list_sort(list_intersect({Q.lits(K.BANNED_OPINION)}, {Q.tokens('text')})), ',') AS b FROM d),
r AS (SELECT doc_id, list_filter([CASE WHEN w NOT BETWEEN 180 AND 260 THEN 'word_count:' || w END,
  CASE WHEN s NOT BETWEEN 7 AND 20 THEN 'sentence_count:' || s END,
  CASE WHEN g NOT BETWEEN 5.0 AND 10.0 THEN 'reading_level:' || g END,
  CASE WHEN b <> '' THEN 'banned_words:' || b END], lambda x: x IS NOT NULL) AS reasons FROM g)"""


@query("quality_gate", f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || ' a shocking miracle' ELSE text END AS text FROM documents), {_GATE}
SELECT doc_id, len(reasons) = 0 AS passed, array_to_string(reasons, ';') AS reasons FROM r""")
def quality_gate(spark, folder):
    d = V.table(spark, folder, "documents").select("doc_id", F.when(
        F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" a shocking miracle"))).otherwise(F.col("text")).alias("summary"))
    return P.quality_gate(d).select("doc_id", "passed", F.array_join("reasons", ";").alias("reasons"))


@query("revalidate", "WITH " + V.CARDS_SQL + f""",
w AS (SELECT *, {Q.word_count('summary')} AS n FROM cards_v)
SELECT card_id, CASE WHEN verified_status = 'published' AND n NOT BETWEEN 150 AND 200 THEN 'pending_review' ELSE verified_status END AS verified_status,
  CASE WHEN verified_status = 'published' AND n NOT BETWEEN 150 AND 200 THEN NULL ELSE {Q.stamp('published_at')} END AS published_at,
  CASE WHEN verified_status = 'published' AND n NOT BETWEEN 150 AND 200 THEN 'legacy_summary_word_count:' || n END AS reason FROM w""")
def revalidate(spark, folder):
    swept, reviews = P.revalidate(V.cards(spark, folder))
    return swept.join(reviews.select("card_id", F.array_join("reasons", ";").alias("reason")), "card_id", "left").select(
        "card_id", "verified_status", stamp("published_at").alias("published_at"), "reason")


@query("route_review", "WITH " + V.CARDS_SQL + f""",
d AS (SELECT card_id AS doc_id, summary AS text FROM cards_v), {_GATE}
SELECT card_id, array_to_string(list_concat(list_filter([CASE WHEN content_type <> 'NEWS' THEN 'content_type:' || content_type END,
    CASE WHEN card_id % 15 = 0 THEN 'flagged_conflict' END,
    CASE WHEN list_has_any({Q.tokens("headline || ' ' || summary || ' ' || headline")}, {Q.lits(K.SENSITIVITY)}) THEN 'sensitivity_keyword' END],
    lambda x: x IS NOT NULL), reasons), ';') AS reasons,
  CASE WHEN content_type = 'NEWS' AND card_id % 15 <> 0 AND len(reasons) = 0
    AND NOT list_has_any({Q.tokens("headline || ' ' || summary")}, {Q.lits(K.SENSITIVITY)}) THEN 'published' ELSE 'pending_review' END AS verified_status
FROM cards_v JOIN r ON doc_id = card_id""")
def route_review(spark, folder):
    cards = V.cards(spark, folder).withColumn("flagged_conflict", F.col("card_id") % 15 == 0).withColumn(
        "article_titles", F.array("headline"))
    return P.route_review(cards).select("card_id", F.array_join("reasons", ";").alias("reasons"), "verified_status")


@query("coerce_card", """
SELECT p_partkey, CASE WHEN upper(p_type) IN ('NEWS', 'PROMOTIONAL', 'OPINION') THEN upper(p_type) ELSE 'UNKNOWN' END AS content_type,
  CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE p_size END AS priority_score FROM part""")
def coerce_card(spark, folder):
    rows = V.table(spark, folder, "part").select(
        "p_partkey", F.col("p_type").alias("content_type"),
        F.when(F.col("p_partkey") % 3 == 0, "high").otherwise(F.col("p_size").cast("string")).alias("priority_score"))
    return P.coerce_card(rows)


@query("active_sources", "WITH " + V.SOURCES_SQL + " SELECT source_id, name FROM sources_v WHERE is_active AND source_type NOT IN ('newsdata_api', 'newsapi_dev_only')")
def active_sources(spark, folder):
    return P.active_sources(V.sources(spark, folder)).select("source_id", "name")


@query("apply_decisions", "WITH " + V.CARDS_SQL + f"""
SELECT c.card_id, CASE l.toxic WHEN 0 THEN 'published' WHEN 1 THEN 'rejected' ELSE verified_status END AS verified_status,
  CASE WHEN l.toxic = 1 THEN NULL ELSE {Q.stamp('published_at')} END AS published_at, coalesce(l.toxic = 0, false) AS approved
FROM cards_v c LEFT JOIN labels l ON l.doc_id = c.card_id""")
def apply_decisions(spark, folder):
    decisions = V.table(spark, folder, "labels").select(
        F.col("doc_id").alias("card_id"), F.when(F.col("toxic") == 1, "reject").otherwise("approve").alias("decision"))
    return P.apply_decisions(V.cards(spark, folder), decisions, V.AS_OF).select(
        "card_id", "verified_status", stamp("published_at").alias("published_at"),
        F.col("feed_published_at").isNotNull().alias("approved"))


@query("saved_cards", "WITH " + V.CARDS_SQL + ", " + V.MARKS_SQL
       + " SELECT card_id FROM cards_v WHERE card_id IN (SELECT card_id FROM marks_v WHERE mark = 'click')")
def saved_cards(spark, folder):
    return P.saved(V.cards(spark, folder), V.marks(spark, folder).filter("mark = 'click'")).select("card_id")


@query("unseen_cards", "WITH " + V.MARKS_SQL + """
SELECT DISTINCT user_id AS device_id, event_id % 1000 AS card_id FROM events e WHERE NOT EXISTS (
  SELECT 1 FROM marks_v m WHERE m.device_id = e.user_id AND m.card_id = e.event_id % 1000)""")
def unseen_cards(spark, folder):
    offered = V.table(spark, folder, "events").selectExpr("user_id as device_id", "event_id % 1000 as card_id").distinct()
    return P.unseen(offered, V.marks(spark, folder))


@query("pending_reviews", "WITH " + V.CARD_SOURCES_SQL + """
SELECT c.card_id, c.headline, string_agg(x.name, ';' ORDER BY x.ord) AS sources FROM cards_v c JOIN card_sources_v x USING (card_id)
WHERE c.verified_status = 'pending_review' GROUP BY 1, 2""")
def pending_reviews(spark, folder):
    cards = V.cards(spark, folder)
    reviews = cards.select("card_id", F.when(F.col("verified_status") == "pending_review", "pending").otherwise("done").alias("status"))
    out = P.pending_reviews(reviews, cards, V.card_sources(spark, folder))
    return out.select("card_id", "headline", F.array_join("sources.name", ";").alias("sources"))


# --- joins -------------------------------------------------------------------------------

@query("cluster_profile", "WITH " + V.ARTICLES_SQL + ", " + V.SOURCES_SQL + """
SELECT id // 2 AS cluster_id, count(*) AS articles, max(s.category) AS category, max(s.name) AS name, max(title) AS title
FROM articles_v a JOIN sources_v s USING (source_id) GROUP BY 1 HAVING count(*) >= 2""")
def cluster_profile(spark, folder):
    arts = V.articles(spark, folder).withColumn("cluster_id", F.expr("id div 2")).drop("category")
    return J.cluster_profile(arts, V.sources(spark, folder), 2)


@query("card_with_sources", "WITH " + V.CARD_SOURCES_SQL + """
SELECT c.card_id, count(x.ord) AS n, string_agg(x.source_id, ',' ORDER BY x.ord) AS source_ids
FROM cards_v c LEFT JOIN card_sources_v x USING (card_id) GROUP BY 1""")
def card_with_sources(spark, folder):
    out = J.with_sources(V.cards(spark, folder), V.card_sources(spark, folder))
    return out.select("card_id", F.size("sources").cast("bigint").alias("n"), F.array_join("sources.source_id", ",").alias("source_ids"))


@query("with_prefs", "WITH " + V.USERS_SQL + """
SELECT c_custkey AS device_id, coalesce(array_to_string(u.category_order, ','), '') AS category_order
FROM customer LEFT JOIN (SELECT * FROM users_v WHERE device_id % 2 = 0) u ON u.device_id = c_custkey""")
def with_prefs(spark, folder):
    users = V.table(spark, folder, "customer").select(F.col("c_custkey").alias("device_id"))
    prefs = V.users(spark, folder).filter("device_id % 2 = 0")
    return J.with_prefs(users, prefs).select("device_id", F.array_join("category_order", ",").alias("category_order"))


@query("fk_clean", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20) THEN l_suppkey END AS l_suppkey
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def fk_clean(spark, folder):
    """Lines of finished orders only; the supplier cleared where it is unknown."""
    done = V.table(spark, folder, "orders").filter("o_orderstatus = 'F'")
    known = V.table(spark, folder, "supplier").filter("s_nationkey < 20")
    lines = V.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return J.fk_null(J.fk_clean(lines, done, "l_orderkey", "o_orderkey"), known, "l_suppkey", "s_suppkey")


@query("not_in_target", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def not_in_target(spark, folder):
    lines = V.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.not_in(V.table(spark, folder, "orders").select("o_orderkey"), lines, "o_orderkey")


_BROKEN = """broken_v AS (SELECT card_id, ord, trust_tier, CASE WHEN card_id % 3 = 0 THEN 'cluster' || card_id ELSE source_id END AS source_id,
  CASE WHEN card_id % 6 = 0 THEN name ELSE 'Nobody ' || ord END AS name FROM card_sources_v)"""


@query("repair_source", "WITH " + V.CARD_SOURCES_SQL + ", " + _BROKEN + f"""
SELECT b.card_id, b.ord, CASE WHEN b.card_id % 3 <> 0 THEN b.source_id WHEN b.card_id % 6 = 0 THEN n.source_id ELSE '{K.SENTINEL_SOURCE_ID}' END AS source_id,
  CASE WHEN b.card_id % 3 = 0 AND b.card_id % 6 <> 0 THEN '3' ELSE b.trust_tier END AS trust_tier,
  CASE WHEN b.card_id % 3 <> 0 THEN 'kept' WHEN b.card_id % 6 = 0 THEN 'matched_by_name' ELSE 'unresolved' END AS outcome
FROM broken_v b LEFT JOIN (SELECT name, max(source_id) AS source_id FROM sources_v GROUP BY 1) n USING (name)""")
def repair_source(spark, folder):
    third, sixth = F.col("card_id") % 3 == 0, F.col("card_id") % 6 == 0
    broken = V.card_sources(spark, folder).select(
        "card_id", "ord", "trust_tier",
        F.when(third, F.concat(F.lit("cluster"), F.col("card_id").cast("string"))).otherwise(F.col("source_id")).alias("source_id"),
        F.when(sixth, F.col("name")).otherwise(F.concat(F.lit("Nobody "), F.col("ord").cast("string"))).alias("name"))
    return J.repair_source(broken, V.sources(spark, folder)).select("card_id", "ord", "source_id", "trust_tier", "outcome")


_PLACES = [(state, kw, i) for i, (state, kws) in enumerate(J.gazetteer_entries().items()) for kw in kws]
# towns stand in a third of the texts, so that most keywords are met
_STATE_TEXT = "raw_text || CASE WHEN id % 3 = 0 THEN ' Rain in ' || coalesce(state, 'Goa') || ', and Assam.' WHEN id % 3 = 1 THEN ' (' || (" \
    + Q.lits([kw for _, kw, _ in _PLACES]) + f")[id % {len(_PLACES)} + 1] || ')!' ELSE '' END"


@query("detect_states", "WITH " + V.ARTICLES_SQL + f""",
g AS (SELECT unnest({Q.lits([s for s, _, _ in _PLACES])}) AS state, unnest({Q.lits([k for _, k, _ in _PLACES])}) AS kw, unnest({[i for _, _, i in _PLACES]}) AS ord),
t AS (SELECT id, ' ' || lower({_STATE_TEXT}) || ' ' AS low FROM articles_v)
SELECT id, arg_min(g.state, g.ord) AS detected_state FROM t JOIN g ON contains(low, kw)
  AND regexp_matches(low, '[\\s,.\\-:''"(\\[{{]' || kw || '[\\s,.\\-:''")!\\]}}]') GROUP BY 1""")
def detect_states(spark, folder):
    town = F.element_at(F.array(*[F.lit(kw) for _, kw, _ in _PLACES]), (F.col("id") % len(_PLACES) + 1).cast("int"))
    t = F.concat("raw_text", F.when(F.col("id") % 3 == 0, F.concat(
        F.lit(" Rain in "), F.coalesce("state", F.lit("Goa")), F.lit(", and Assam."))).when(
        F.col("id") % 3 == 1, F.concat(F.lit(" ("), town, F.lit(")!"))).otherwise(""))
    return J.detect_states(V.articles(spark, folder), J.gazetteer_rows(spark), "id", t)


@query("clusters_without_card", "SELECT DISTINCT l_partkey AS cluster_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def clusters_without_card(spark, folder):
    clusters = V.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("cluster_id")).distinct()
    cards = V.table(spark, folder, "part").filter("p_size > 10").select(F.col("p_partkey").alias("cluster_id"))
    return J.clusters_without_card(clusters, cards)


@query("merge_master", "WITH " + V.CARDS_SQL + """
SELECT CAST(card_id AS VARCHAR) AS id, CASE WHEN card_id % 2 = 0 THEN 'new' ELSE 'old' END AS version FROM cards_v
UNION ALL SELECT 'x' || card_id, 'new' FROM cards_v WHERE card_id % 10 = 0""")
def merge_master(spark, folder):
    cards = V.cards(spark, folder)
    none = F.lit(None).cast("string")
    old = cards.select(F.col("card_id").cast("string").alias("id"), none.alias("canonical_url"), "headline", F.lit("old").alias("version"))
    new = old.filter("cast(id as bigint) % 2 = 0").withColumn("version", F.lit("new"))
    more = old.filter("cast(id as bigint) % 10 = 0").withColumn("id", F.concat(F.lit("x"), "id")).withColumn("version", F.lit("new"))
    return J.merge_master(old, new.union(more)).select("id", "version")


@query("compare_feeds", "WITH " + SQ.PUBLISHED_SQL + " SELECT card_id FROM scored_v WHERE card_id % 50 = 0")
def compare_feeds(spark, folder):
    """Two runs of the same scores, every fiftieth changed."""
    out = R.rescore(V.cards(spark, folder), V.card_sources(spark, folder), V.AS_OF).select(
        "card_id", "importance_score", "urgency_score", "freshness_score", "verification_score")
    changed = out.withColumn("urgency_score", F.when(F.col("card_id") % 50 == 0, -1.0).otherwise(F.col("urgency_score")))
    return J.compare_feeds(out, changed)


@query("union_articles", "WITH " + V.ARTICLES_SQL + """
SELECT 'docs' AS provider, url, title FROM articles_v UNION ALL SELECT 'pages', url, NULL FROM pages UNION ALL SELECT 'talks', NULL, text FROM conversations""")
def union_articles(spark, folder):
    docs = V.articles(spark, folder).select(F.lit("docs").alias("provider"), "url", "title")
    pages = V.table(spark, folder, "pages").select(F.lit("pages").alias("provider"), "url")
    talks = V.table(spark, folder, "conversations").select(F.lit("talks").alias("provider"), F.col("text").alias("title"))
    return J.union_articles(docs, pages, talks).select("provider", "url", "title")


@query("set_overlap", """
SELECT 'both' AS part, * FROM (SELECT l_partkey FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size <= 25)
UNION ALL SELECT 'only_left', * FROM (SELECT l_partkey FROM lineitem EXCEPT ALL SELECT p_partkey FROM part WHERE p_size <= 25)""")
def set_overlap(spark, folder):
    a = V.table(spark, folder, "lineitem").select("l_partkey")
    b = V.table(spark, folder, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    return A.overlap(a, b).withColumn("part", F.lit("both")).unionByName(A.difference(a, b).withColumn("part", F.lit("only_left")))


# --- state, sinks, migration ------------------------------------------------------------------

@query("latest_by_key", "WITH " + V.RUNS_SQL + f"""
SELECT provider, arg_max(run_id, (timestamp, run_id)) AS run_id, {Q.stamp("max(timestamp)")} AS last_run FROM runs_v GROUP BY 1""")
def latest_by_key(spark, folder):
    runs = V.runs(spark, folder).select("provider", "timestamp", "run_id")
    return J.latest_by_key(runs, "provider", "timestamp").select("provider", "run_id", stamp("timestamp").alias("last_run"))


@query("apply_changes", """
WITH c AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS op, arg_max(event_id, (ts, event_id)) AS v FROM events GROUP BY 1),
s AS (SELECT c_custkey AS device_id, CAST(-1 AS BIGINT) AS value FROM customer)
SELECT coalesce(s.device_id, c.user_id) AS device_id,
  CASE WHEN c.user_id IS NULL OR (op = 'click' AND s.device_id IS NOT NULL) THEN s.value ELSE c.v END AS value
FROM s FULL JOIN c ON c.user_id = s.device_id WHERE op IS NULL OR op <> 'error'""")
def apply_changes(spark, folder):
    """Events as changes: click adds (existing rows stay), error removes, the rest put."""
    state = V.table(spark, folder, "customer").select(F.col("c_custkey").alias("device_id"), F.lit(-1).cast("bigint").alias("value"))
    op = F.when(F.col("event_type") == "click", "add").when(F.col("event_type") == "error", "remove").otherwise("put")
    changes = V.table(spark, folder, "events").select(
        F.col("user_id").alias("device_id"), F.struct("ts", "event_id").alias("ts"), op.alias("op"), F.col("event_id").alias("value"))
    return J.apply_changes(state, changes, "device_id")


_URLS = "(SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS link FROM pages)"


def _links(spark, folder):
    return V.table(spark, folder, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/$", "").alias("link"))


@query("known_links", f"SELECT DISTINCT link FROM {_URLS}")
def known_links(spark, folder):
    return SA.known_links(_links(spark, folder))


@query("append_unique", f"""
SELECT DISTINCT link FROM {_URLS} WHERE link NOT IN (SELECT link FROM {_URLS} WHERE page_id % 3 = 0)""")
def append_unique(spark, folder):
    rows = _links(spark, folder)
    return SA.append_unique(rows, rows.filter("page_id % 3 = 0")).select("link")


@query("insert_counts", f"""
WITH u AS (SELECT * FROM {_URLS}), n AS (SELECT DISTINCT link FROM u WHERE link NOT IN (SELECT link FROM u WHERE page_id % 3 = 0))
SELECT (SELECT count(*) FROM u) AS offered, (SELECT count(*) FROM n) AS inserted, (SELECT count(*) FROM u) - (SELECT count(*) FROM n) AS duplicates""")
def insert_counts(spark, folder):
    rows = _links(spark, folder)
    return SA.write_new(rows, rows.filter("page_id % 3 = 0"), new_folder(spark, "inserts"))


@query("insert_new", f"""
SELECT link, min(page_id) AS page_id FROM {_URLS} WHERE link NOT IN (SELECT link FROM {_URLS} WHERE page_id % 3 = 0) GROUP BY 1""")
def insert_new(spark, folder):
    rows = _links(spark, folder)
    return SA.insert_new(rows, rows.filter("page_id % 3 = 0"), order=["page_id"]).select("link", "page_id")


@query("rerun_delta", f"SELECT page_id FROM {_URLS} WHERE page_id % 3 <> 0")
def rerun_delta(spark, folder):
    rows = _links(spark, folder)
    return A.rerun_delta(rows.filter("page_id % 3 = 0"), rows, "page_id").select("page_id")


@query("upsert_cards", """
SELECT p_partkey AS card_id, CAST(p_partkey AS VARCHAR) AS headline, CASE WHEN p_size <= 25 THEN 'new' ELSE 'old' END AS summary,
  CASE WHEN p_size <= 25 THEN p_size * 2.0 ELSE 0.0 END AS importance_score, p_brand AS category FROM part
UNION ALL SELECT 1000000 + s_suppkey, 's' || s_suppkey, 'new', 7.0, 'Added' FROM supplier""")
def upsert_cards(spark, folder):
    part = V.table(spark, folder, "part")
    old = part.select(F.col("p_partkey").alias("card_id"), F.col("p_partkey").cast("string").alias("headline"),
                      F.lit("old").alias("summary"), F.lit(0.0).alias("importance_score"), F.col("p_brand").alias("category"))
    again = part.filter("p_size <= 25").select(
        (F.col("p_partkey") + 5000000).alias("card_id"), F.col("p_partkey").cast("string").alias("headline"),
        F.lit("new").alias("summary"), (F.col("p_size") * 2.0).alias("importance_score"), F.lit("Changed").alias("category"))
    more = V.table(spark, folder, "supplier").select(
        (F.col("s_suppkey") + 1000000).alias("card_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("headline"),
        F.lit("new").alias("summary"), F.lit(7.0).alias("importance_score"), F.lit("Added").alias("category"))
    return ST.upsert_cards(old, again.union(more))


@query("feed_snapshot", "WITH " + V.CARDS_SQL + """,
o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY priority_score DESC, card_id) - 1 AS place, count(*) OVER (PARTITION BY category) AS n FROM cards_v)
SELECT category, 'ok' AS status, '2024-02-01T00:00:00Z' AS updated_at, n AS "count", place // 40 AS part,
  string_agg(card_id, ',' ORDER BY place) AS ids FROM o GROUP BY category, n, place // 40""")
def feed_snapshot(spark, folder):
    """The stored snapshot, read back by its pointer."""
    cards = V.cards(spark, folder).select("card_id", "category", F.col("priority_score").cast("double").alias("final_feed_score"))
    path = new_folder(spark, "snapshot")
    ST.write_feed_snapshot(cards.filter("card_id % 2 = 0"), V.AS_OF, path, "category")
    ST.write_feed_snapshot(cards, V.AS_OF, path, "category", size=40)
    return read_version(spark, path).select("category", "status", "updated_at", "count", "part", F.array_join(
        F.transform("items.card_id", lambda c: c.cast("string")), ",").alias("ids"))


@query("source_catalogue", """
SELECT s_name AS name, 'national' AS category, CAST(max(s_nationkey) AS VARCHAR) AS region, '2' AS trust_tier, 'rss' AS source_type,
  true AS is_active FROM supplier GROUP BY s_name""")
def source_catalogue(spark, folder):
    rows = V.table(spark, folder, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("region"))
    return SA.catalogue(rows).select("name", "category", "region", "trust_tier", "source_type", "is_active")


def _migration(spark, folder):
    cards = V.cards(spark, folder)
    cites = V.card_sources(spark, folder)
    arts = V.articles(spark, folder).withColumn("cluster_id", F.expr("id div 2"))
    tables = {
        "sources": V.sources(spark, folder).filter("source_id <> 'src3'"),
        "clusters": cards.select("cluster_id").distinct().filter("cluster_id % 5 <> 0"),
        "articles": arts, "cards": cards, "card_sources": cites,
        "reviews": cards.select("card_id", F.lit("pending").alias("status")),
        "runs": V.runs(spark, folder),
    }
    return tables, ST.migrate(tables)


_MIGRATE = V.CARD_SOURCES_SQL + ", " + V.RUNS_SQL + """,
ms AS (SELECT * FROM sources_v WHERE source_id <> 'src3'),
mc AS (SELECT DISTINCT cluster_id FROM cards_v WHERE cluster_id % 5 <> 0),
ma AS (SELECT id FROM articles_v WHERE source_id IN (SELECT source_id FROM ms)),
mk AS (SELECT * FROM cards_v WHERE created_by <> 'seed' AND cluster_id IN (SELECT cluster_id FROM mc)),
mx AS (SELECT * FROM card_sources_v WHERE card_id IN (SELECT card_id FROM mk))"""


@query("migration_stats", "WITH " + _MIGRATE + """,
s AS (SELECT 'sources' AS table_name, (SELECT count(*) FROM sources_v WHERE source_id <> 'src3') AS rows_in, (SELECT count(*) FROM ms) AS rows_out
UNION ALL SELECT 'clusters', (SELECT count(*) FROM mc), (SELECT count(*) FROM mc)
UNION ALL SELECT 'articles', (SELECT count(*) FROM articles_v), (SELECT count(*) FROM ma)
UNION ALL SELECT 'cards', (SELECT count(*) FROM cards_v), (SELECT count(*) FROM mk)
UNION ALL SELECT 'card_sources', (SELECT count(*) FROM card_sources_v), (SELECT count(*) FROM mx)
UNION ALL SELECT 'reviews', (SELECT count(*) FROM cards_v), (SELECT count(*) FROM mk)
UNION ALL SELECT 'runs', (SELECT count(*) FROM runs_v), (SELECT count(*) FROM runs_v))
SELECT *, rows_in - rows_out AS skipped FROM s""")
def migration_stats(spark, folder):
    tables, moved = _migration(spark, folder)
    return ST.write_migration(tables, moved, new_folder(spark, "migration"))


@query("migrate_citations", "WITH " + _MIGRATE + f"""
SELECT card_id, ord, CASE WHEN source_id <> 'src3' THEN source_id ELSE coalesce(
    (SELECT max(m.source_id) FROM ms m WHERE m.name = mx.name), '{K.SENTINEL_SOURCE_ID}') END AS source_id FROM mx""")
def migrate_citations(spark, folder):
    _, moved = _migration(spark, folder)
    return moved["card_sources"].select("card_id", "ord", "source_id")


# --- audits -------------------------------------------------------------------------------------

@query("daily_credits", "WITH " + V.RUNS_SQL + """
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, provider, CAST(sum(greatest(0, credits_used)) AS BIGINT) AS credits,
  CAST(greatest(0, 250 - sum(greatest(0, credits_used))) AS BIGINT) AS remaining FROM runs_v GROUP BY 1, 2""")
def daily_credits(spark, folder):
    runs = V.runs(spark, folder)
    budgets = {t: 250 for t in ("click", "error", "purchase", "signup", "view")}
    out = A.remaining_credits(A.daily_credits(runs), budgets)
    return out.select(F.col("day").cast("string").alias("day"), "provider", "credits", F.col("remaining").cast("bigint").alias("remaining"))


@query("ingestion_health", "WITH " + V.RUNS_SQL + f""",
l AS (SELECT provider, arg_max(run_id, (timestamp, run_id)) AS run_id FROM runs_v GROUP BY 1),
r AS (SELECT r.*, (epoch_us(TIMESTAMP '2024-01-30 23:00:00') - epoch_us(timestamp)) / 1e6 AS age FROM runs_v r JOIN l USING (provider, run_id))
SELECT provider, run_id, CASE WHEN age > 10800 THEN 'stale' WHEN len(errors) > 0 AND articles_ingested = 0 THEN 'failed'
  WHEN len(errors) > 0 THEN 'degraded' ELSE 'ok' END AS status, round(age, 1) AS seconds_since_last_run FROM r""")
def ingestion_health(spark, folder):
    return A.ingestion_health(V.runs(spark, folder), "2024-01-30 23:00:00", 3600, ("provider",))


@query("counts_by", "WITH " + V.CARDS_SQL + """
SELECT 'category' AS facet, category AS value, count(*) AS n FROM cards_v GROUP BY 2
UNION ALL SELECT 'verified_status', verified_status, count(*) FROM cards_v GROUP BY 2
UNION ALL SELECT 'state', state, count(*) FROM cards_v GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM cards_v""")
def counts_by(spark, folder):
    return A.counts_by(V.cards(spark, folder), "category", "verified_status", "state")


@query("duplicate_headlines", "WITH " + V.ARTICLES_SQL + " SELECT lower(title) AS headline, count(*) AS n FROM articles_v GROUP BY 1 HAVING count(*) > 1")
def duplicate_headlines(spark, folder):
    return A.duplicate_keys(V.articles(spark, folder), F.lower("title"), "headline")


@query("url_surplus", f"WITH n AS (SELECT link, count(*) AS n FROM {_URLS} GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS urls, CAST(sum(n - 1) AS BIGINT) AS surplus FROM n")
def url_surplus(spark, folder):
    return A.url_surplus(_links(spark, folder), "link")


@query("coverage", "WITH " + V.CARDS_SQL + f""",
t AS (SELECT unnest({Q.lits(V.STATE_NAMES)}) AS name, CAST(20 AS BIGINT) AS target),
h AS (SELECT lower(state) AS k, count(*) AS have FROM cards_v WHERE verified_status = 'published' GROUP BY 1)
SELECT name, target, coalesce(have, 0) AS have, coalesce(have, 0) >= target AS met, greatest(0, target - coalesce(have, 0)) AS gap
FROM t LEFT JOIN h ON lower(name) = k""")
def coverage(spark, folder):
    targets = spark.createDataFrame([(s, 20) for s in V.STATE_NAMES], "name string, target bigint")
    return A.coverage(V.cards(spark, folder).filter("verified_status = 'published'"), targets, "state")


@query("diversity_loss", "WITH " + V.CARDS_SQL + """,
r AS (SELECT *, row_number() OVER (ORDER BY priority_score DESC, card_id) AS rank FROM cards_v),
g AS (SELECT coalesce(state, 'National') AS bucket, count(*) AS valid, count(*) FILTER (rank <= 200) AS survived FROM r GROUP BY 1)
SELECT bucket, valid, survived, valid - survived AS lost, round((valid - survived)::DOUBLE / valid * 100, 4) AS loss_pct FROM g""")
def diversity_loss(spark, folder):
    ranked = positions(V.cards(spark, folder).select("card_id", "state", "priority_score"),
                       [F.desc("priority_score"), F.col("card_id")], "rank")
    return A.diversity_loss(ranked, F.coalesce("state", F.lit("National")), 200)


@query("profile", "WITH " + V.CARDS_SQL + f"""
SELECT count(*) AS rows, count(*) FILTER (state IS NULL) AS missing_state, count(*) FILTER (published_at IS NULL) AS missing_published_at,
  CAST(min(priority_score) AS DOUBLE) AS min_score, CAST(max(priority_score) AS DOUBLE) AS max_score, 0 AS nan_scores, 0 AS out_of_range,
  min({Q.word_count('summary')}) AS min_words, max({Q.word_count('summary')}) AS max_words, round(avg({Q.word_count('summary')}), 4) AS avg_words FROM cards_v""")
def profile(spark, folder):
    return A.profile(V.cards(spark, folder), ["state", "published_at"], "priority_score", "summary")


@query("audit_rates", """
WITH v AS (SELECT quality = 1 AS pub, doc_id % 5 <> 0 AS elig, toxic = 1 AS conf, doc_id % 20 = 0 AS dup FROM labels)
SELECT round(avg(CASE WHEN pub THEN CAST(NOT elig OR conf AS INT) END) * 100, 4) AS false_publish_pct,
  round(avg(CASE WHEN NOT pub THEN CAST(elig AND NOT conf AS INT) END) * 100, 4) AS false_hold_pct,
  round(avg(CASE WHEN pub THEN CAST(dup AS INT) END) * 100, 4) AS duplicate_pct, 0.0 AS summary_error_pct FROM v""")
def audit_rates(spark, folder):
    v = V.table(spark, folder, "labels").select(
        (F.col("quality") == 1).alias("is_published"), (F.col("doc_id") % 5 != 0).alias("eligible"),
        (F.col("toxic") == 1).alias("flagged_conflict"), (F.col("doc_id") % 20 == 0).alias("is_duplicate"),
        F.lit(False).alias("summary_error"))
    return A.audit_rates(v)


@query("sweep_requests", "WITH " + V.REQUESTS_SQL + """,
leases AS (SELECT 'worker' || c_custkey AS w, c_custkey % 3 AS g FROM customer WHERE c_custkey < 50),
j AS (SELECT r.*, l.w IS NOT NULL AS held, epoch(TIMESTAMP '2001-01-01 00:00:00') - epoch(created_at) AS age
  FROM requests_v r LEFT JOIN leases l ON l.w = r.worker_id AND l.g = r.lease_generation),
s AS (SELECT *, status = 'running' AND (age > 31536000 OR NOT held) AS lost, CASE WHEN attempt_count = 0 THEN 1 ELSE attempt_count END AS att FROM j)
SELECT request_id, lost AS swept, CASE WHEN lost AND att < 3 THEN 'pending' WHEN lost THEN 'failed' ELSE status END AS status,
  CASE WHEN lost AND att < 3 THEN NULL ELSE worker_id END AS worker_id FROM s""")
def sweep_requests(spark, folder):
    leases = V.table(spark, folder, "customer").filter("c_custkey < 50").select(
        F.concat(F.lit("worker"), F.col("c_custkey").cast("string")).alias("worker_id"),
        (F.col("c_custkey") % 3).cast("int").alias("lease_generation"), F.lit("2001-01-01 00:10:00").cast("timestamp").alias("expires_at"))
    out = A.sweep_requests(V.requests(spark, folder), leases, "2001-01-01 00:00:00", 31536000)
    return out.select("request_id", "swept", "status", "worker_id")


@query("stratified_sample", "WITH " + V.CARDS_SQL + """
SELECT category, card_id FROM cards_v QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5(card_id || '|7'), card_id) <= 10""")
def stratified_sample(spark, folder):
    return A.stratified_sample(V.cards(spark, folder), "category", "card_id", 10, "7").select("category", "card_id")


@query("assemble_cards", "WITH " + V.ARTICLES_SQL + ", " + V.SOURCES_SQL + """,
a AS (SELECT a.id // 2 AS cluster_id, a.*, s.source_type FROM articles_v a JOIN sources_v s USING (source_id)),
l AS (SELECT cluster_id, arg_min({'c': category, 's': state, 'd': district, 't': title, 'b': raw_text}, id) AS x,
  bool_or(source_type = 'newsapi_dev_only') AS dev FROM a GROUP BY 1)
SELECT cluster_id, substring(x.t || ' ' || x.b, 1, 255) AS headline, x.c AS category, x.s AS state, x.d AS district,
  CASE WHEN dev THEN 'dev_testing' ELSE 'live_pipeline' END AS created_by FROM l""")
def assemble_cards(spark, folder):
    arts = V.articles(spark, folder).join(V.sources(spark, folder).select("source_id", "source_type"), "source_id").withColumn(
        "cluster_id", F.expr("id div 2")).withColumn("ord", F.col("id"))
    drafts = arts.groupBy("cluster_id").agg(F.min_by(F.concat_ws(" ", "title", "raw_text"), "id").alias("headline")).withColumn(
        "summary", F.lit(""))
    return A.assemble_cards(arts, drafts).select("cluster_id", "headline", "category", "state", "district", "created_by")


@query("source_excerpts", "WITH " + V.ARTICLES_SQL + ", " + V.SOURCES_SQL + """
SELECT id // 2 AS cluster_id, string_agg(name || chr(10) || url || chr(10) || title || chr(10) || substring(raw_text, 1, 800),
  chr(10) || chr(10) || '-----' || chr(10) || chr(10) ORDER BY id) AS source_excerpts FROM articles_v JOIN sources_v USING (source_id) GROUP BY 1""")
def source_excerpts(spark, folder):
    arts = V.articles(spark, folder).join(V.sources(spark, folder).select("source_id", "name"), "source_id").select(
        F.expr("id div 2").alias("cluster_id"), F.col("id").alias("ord"), "name", "url", "title", F.col("raw_text").alias("body"))
    return A.excerpts(arts)


@query("chronology", "WITH " + V.ARTICLES_SQL + f""",
a AS (SELECT id // 7 AS cluster_id, id, published_at AS p, id % 3 = 0 AS wire FROM articles_v),
g AS (SELECT cluster_id, min(p) AS first, max(p) FILTER (NOT wire) AS latest, first(p ORDER BY id) AS lead,
  list(p) FILTER (NOT wire AND p IS NOT NULL) AS own FROM a GROUP BY 1)
SELECT cluster_id, {Q.stamp('first')} AS first_reported_at, {Q.stamp('coalesce(latest, first)')} AS latest_independent_at,
  {Q.stamp('CASE WHEN list_contains(own, lead) THEN lead ELSE coalesce(first, lead) END')} AS published_at FROM g""")
def chronology(spark, folder):
    arts = V.articles(spark, folder).select(F.expr("id div 7").alias("cluster_id"), "id", "published_at", (F.col("id") % 3 == 0).alias("is_wire"))
    out = A.chronology(arts, "id")
    return out.select("cluster_id", *[stamp(c).alias(c) for c in ("first_reported_at", "latest_independent_at", "published_at")])


_IMP_TEXT = Q.ascii_words("lower(" + Q.clean_text('title') + " || ' ' || " + Q.clean_text('summary') + ")")


@query("cluster_importance", "WITH " + V.ARTICLES_SQL + ", " + V.SOURCES_SQL + f""",
a AS (SELECT id // 5 AS cluster_id, id, lower(s.name) AS src, title || CASE WHEN id % 4 = 0 THEN ' budget summit war' ELSE '' END AS title, raw_text AS summary
  FROM articles_v JOIN sources_v s USING (source_id)),
h AS (SELECT *, {_IMP_TEXT} AS t FROM a),
g AS (SELECT cluster_id, count(DISTINCT src) AS d, count(*) FILTER ({Q.contains_any('src', K.CRAWL_TIER_1)}) AS t1,
  {" + ".join(f"CAST(bool_or({Q.matches('t', chr(92) + 'b' + w + chr(92) + 'b')}) AS INT)" for w in K.CRAWL_IMPACT_TERMS)} AS k FROM h GROUP BY 1),
p AS (SELECT *, greatest(1, least(10, 5 + CASE WHEN d >= 4 THEN 3 WHEN d >= 2 THEN 2 ELSE 0 END
  + CASE WHEN t1 >= 2 THEN 2 WHEN t1 = 1 THEN 1 ELSE 0 END + CASE WHEN k >= 3 THEN 3 WHEN k >= 1 THEN 2 ELSE 0 END)) AS pr FROM g)
SELECT cluster_id, CAST(pr AS BIGINT) AS priority, CAST(k AS BIGINT) AS keyword_hits, round(pr * 10.0 + d * 6.0 + t1 * 4.0 + k * 8.0, 2) AS importance_score FROM p""")
def cluster_importance(spark, folder):
    arts = V.articles(spark, folder).join(V.sources(spark, folder).select("source_id", F.col("name").alias("source")), "source_id")
    rows = arts.select(F.expr("id div 5").alias("cluster_id"), "source", F.concat("title", F.when(
        F.col("id") % 4 == 0, " budget summit war").otherwise("")).alias("title"), F.col("raw_text").alias("summary"))
    return A.cluster_importance(rows).select("cluster_id", F.col("priority").cast("bigint").alias("priority"),
                                             F.col("keyword_hits").cast("bigint").alias("keyword_hits"), "importance_score")


@query("rank_in_pools", """
SELECT o_orderkey, CASE WHEN n <= 50 THEN rank() OVER (PARTITION BY n <= 50 ORDER BY o_totalprice DESC) END AS rank_in_50,
  rank() OVER (ORDER BY o_totalprice DESC) AS rank_in_all FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders)""")
def rank_in_pools(spark, folder):
    orders = positions(V.table(spark, folder, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], "n")
    out = R.rank_in_pools(orders, "o_totalprice", "n", (50,))
    return out.select("o_orderkey", F.col("rank_in_50").cast("bigint").alias("rank_in_50"), F.col("rank_in_all").cast("bigint").alias("rank_in_all"))


@query("text_host_counts", r"""
SELECT regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^www\.', '') AS host, count(*) AS n FROM pages GROUP BY 1""")
def text_host_counts(spark, folder):
    return V.table(spark, folder, "pages").groupBy(urls.host_of("url").alias("host")).agg(F.count(F.lit(1)).alias("n"))


