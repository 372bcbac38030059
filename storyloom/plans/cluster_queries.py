"""Similarity, clustering, independence and numeric conflicts."""

from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions.text import norm
from storyloom.operators import clustering as L
from storyloom.operators import similarity as M
from storyloom.operators import vector_join as VJ
from storyloom.operators import verification as C
from storyloom.plans import fixtures as V
from storyloom.plans import sqltext as Q
from storyloom.plans.registry import query

K2 = "pow(1 + ln(1.5), 2)"


def _tokens(x, stop=()):
    t = rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]{{2,}}')"
    return f"list_filter({t}, lambda w: NOT list_contains({Q.lits(stop)}, w))" if stop else t


def _terms(name, source, text, stop=()):
    """CTEs <name>_t (id, w, tf) and <name>_s (id, sq)."""
    return f"""{name}_t AS MATERIALIZED (SELECT id, w, count(*)::DOUBLE AS tf FROM (SELECT id, unnest({_tokens(text, stop)}) AS w FROM {source}) GROUP BY 1, 2),
{name}_s AS (SELECT id, sum(tf * tf) AS sq FROM {name}_t GROUP BY 1)"""


def _sims(name, scope="true", pairs=None):
    """CTE <name>_sim (a, b, sim) over pairs a < b that share a term."""
    if pairs:
        source = f"{pairs} p JOIN {name}_t x ON x.id = p.a JOIN {name}_t y ON y.id = p.b AND y.w = x.w"
        a, b = "p.a", "p.b"
    else:
        source = f"{name}_t x JOIN {name}_t y ON y.w = x.w AND x.id < y.id"
        a, b = "x.id", "y.id"
    return f"""{name}_sim AS MATERIALIZED (SELECT a, b, round(d / sqrt((qa + {K2} * (sa.sq - qa)) * (qb + {K2} * (sb.sq - qb))), 12) AS sim
  FROM (SELECT {a} AS a, {b} AS b, sum(x.tf * y.tf) AS d, sum(x.tf * x.tf) AS qa, sum(y.tf * y.tf) AS qb FROM {source} GROUP BY 1, 2)
  JOIN {name}_s sa ON sa.id = a JOIN {name}_s sb ON sb.id = b WHERE {scope})"""


# --- pair similarity of neighbours: the closed form ----------------------------------

@query("tfidf_neighbours", "WITH " + V.ARTICLES_SQL + f""",
n AS (SELECT id, lower({Q.collapse("title || chr(10) || raw_text")}) AS t FROM articles_v),
p AS (SELECT id - 1 AS a, id AS b FROM articles_v WHERE id > 0),
{_terms('n', 'n', 't')},
{_sims('n', pairs='p')}
SELECT p.b AS id, coalesce(round(sim, 6), 0.0) AS similarity FROM p LEFT JOIN n_sim s ON s.a = p.a AND s.b = p.b""")
def tfidf_neighbours(spark, folder):
    arts = V.articles(spark, folder)
    texts = arts.select(F.col("id").alias("nid"), norm(F.concat_ws("\n", "title", "raw_text")).alias("text"))
    pairs = arts.filter("id > 0").select(F.col("id").alias("nid"), (F.col("id") - 1).alias("other"))
    sims = M.text_cosine(pairs, texts)
    return pairs.join(sims, ["nid", "other"], "left").select(
        F.col("nid").alias("id"), F.coalesce(F.round("sim", 6), F.lit(0.0)).alias("similarity"))


# --- audit of the pair prefilter ------------------------------------------------------------

_CUTOFF = f"TIMESTAMP '{V.AS_OF}' - INTERVAL 24 HOURS"
_RECENT = f"(coalesce(published_at >= {_CUTOFF}, false) OR coalesce(ingested_at >= {_CUTOFF}, false))"
_AUDIT = f""",
k AS (SELECT id, category, state, district, {_RECENT} AS recent, {Q.keywords('title', K.WORKER_STOPWORDS)} AS words FROM %s),
p AS (SELECT a.id, len(list_intersect(a.words, b.words)) AS shared FROM k a JOIN k b ON a.id <> b.id AND b.recent
  AND (a.category IS NULL OR a.category = b.category) AND (a.state IS NULL OR a.state = b.state) AND (a.district IS NULL OR a.district = b.district))
SELECT k.id, count(p.shared) AS candidates, count(*) FILTER (p.shared >= 2) AS evaluated, count(*) FILTER (p.shared = 1) AS rejected_one_shared,
  count(*) FILTER (p.shared = 0) AS rejected_none_shared FROM k LEFT JOIN p USING (id) GROUP BY 1"""


@query("prefilter_audit", "WITH " + V.ARTICLES_SQL + _AUDIT % "articles_v")
def prefilter_audit(spark, folder):
    return M.prefilter_audit(V.articles(spark, folder), V.AS_OF)


@query("prefilter_audit_one_shard", "WITH " + V.ONE_SHARD_SQL + _AUDIT % "one_shard_v")
def prefilter_audit_one_shard(spark, folder):
    return M.prefilter_audit(V.one_shard(spark, folder), V.AS_OF)


@query("shard_stats", "WITH " + V.ARTICLES_SQL + (_AUDIT % "articles_v").replace("SELECT k.id, count", ", c AS (SELECT k.id, count", 1) + """)
SELECT count(*) AS articles, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(evaluated) AS BIGINT) AS evaluated,
  round(100.0 * (1 - sum(candidates)::DOUBLE / (count(*) * count(*)::DOUBLE)), 4) AS reduction_pct FROM c""")
def shard_stats(spark, folder):
    """Pairs left by the shard filter and by the keyword filter."""
    audit = M.prefilter_audit(V.articles(spark, folder), V.AS_OF)
    n = F.count(F.lit(1))
    return audit.agg(n.alias("articles"), F.sum("candidates").alias("candidates"), F.sum("evaluated").alias("evaluated"),
                     F.round(100.0 * (1 - F.sum("candidates") / (n.cast("double") * n)), 4).alias("reduction_pct"))


# --- story clusters ------------------------------------------------------------------------------

def _leader_sql(view):
    text = "CASE WHEN s <> '' THEN t || ' ' || s ELSE t END"
    stop = K.CRAWL_STOPWORDS
    return f""",
c AS MATERIALIZED (SELECT id, {Q.clean_text('title')} AS t, {Q.clean_text('raw_text')} AS s, lower(coalesce(category, '')) AS cat,
  lower(coalesce(state, '')) AS st, epoch(published_at) AS at,
  CASE WHEN coalesce(district, '') <> '' THEN lower(district)
    ELSE regexp_extract({Q.ascii_words("lower(title || ' ' || raw_text)")}, '\\bdistrict\\s+([a-z]+)\\b', 1) END AS di FROM {view}),
x AS MATERIALIZED (SELECT *, lower({text}) AS full_text, lower(t) AS head_text, {Q.keywords(text, stop)} AS words FROM c),
{_terms('f', 'x', 'full_text', stop)},
{_terms('h', 'x', 'head_text', stop)},
{_sims('f', 'd > 0')},
{_sims('h', 'd > 0')},
e AS MATERIALIZED (SELECT a, b, max(sim) AS sim FROM (SELECT * FROM f_sim UNION ALL SELECT * FROM h_sim) GROUP BY 1, 2 HAVING max(sim) >= 0.38),
g AS MATERIALIZED (SELECT a, b, sim FROM e JOIN x l ON l.id = a JOIN x r ON r.id = b
  WHERE l.cat = r.cat AND l.st = r.st AND (l.di = '' OR r.di = '' OR l.di = r.di) AND coalesce(abs(l.at - r.at) <= 129600, true)
    AND len(list_intersect(l.words, r.words)) >= 2),
o AS MATERIALIZED (SELECT x.id, row_number() OVER (ORDER BY x.id) AS n,
  coalesce((SELECT list(a) FROM g WHERE g.b = x.id), []) AS before FROM x),
walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS leaders
  UNION ALL SELECT o.n, CASE WHEN list_has_any(o.before, w.leaders) THEN w.leaders ELSE list_append(w.leaders, o.id) END
  FROM walk w JOIN o ON o.n = w.n + 1),
lead AS (SELECT unnest(arg_max(leaders, n)) AS id FROM walk),
best AS (SELECT b AS id, arg_max(a, (sim, -a)) AS cluster_id, max(sim) AS sim FROM g WHERE a IN (SELECT id FROM lead) GROUP BY 1)
SELECT x.id, coalesce(best.cluster_id, x.id) AS cluster_id, round(best.sim, 6) AS similarity FROM x LEFT JOIN best USING (id)"""


def _leader(df):
    out = L.leader_cluster(df.withColumnRenamed("raw_text", "summary"))
    return out.select("id", "cluster_id", F.round("similarity", 6).alias("similarity"))


@query("leader_clusters", "WITH RECURSIVE " + V.ONE_SHARD_SQL + _leader_sql("one_shard_v"))
def leader_clusters(spark, folder):
    """Best-leader clusters when all articles share a shard."""
    return _leader(V.one_shard(spark, folder))


@query("leader_clusters_sharded", "WITH RECURSIVE " + V.ARTICLES_SQL + _leader_sql("articles_v"))
def leader_clusters_sharded(spark, folder):
    return _leader(V.articles(spark, folder))


def _first_sql(view):
    return f""",
k AS MATERIALIZED (SELECT id, category, state, district, {_RECENT} AS recent, {Q.keywords('title', K.WORKER_STOPWORDS)} AS words,
  lower({Q.collapse("title || chr(10) || raw_text")}) AS t FROM {view}),
p AS MATERIALIZED (SELECT b.id AS a, a.id AS b FROM k a JOIN k b ON b.id < a.id AND b.recent
  AND (a.category IS NULL OR a.category = b.category) AND (a.state IS NULL OR a.state = b.state) AND (a.district IS NULL OR a.district = b.district)
  AND len(list_intersect(a.words, b.words)) >= 2),
{_terms('n', 'k', 't')},
{_sims('n', pairs='p')},
par AS MATERIALIZED (SELECT k.id, (SELECT min(a) FROM n_sim s WHERE s.b = k.id AND s.sim >= 0.35) AS parent_id FROM k),
up AS (SELECT id, parent_id, id AS cur FROM par UNION ALL SELECT up.id, up.parent_id, par.parent_id FROM up JOIN par ON par.id = up.cur WHERE par.parent_id IS NOT NULL)
SELECT id, any_value(parent_id) AS parent_id, min(cur) AS cluster_id FROM up GROUP BY 1"""


@query("first_match_clusters", "WITH RECURSIVE " + V.ONE_SHARD_SQL + _first_sql("one_shard_v"))
def first_match_clusters(spark, folder):
    """First-match clusters when all articles share a shard."""
    return L.first_match_cluster(V.one_shard(spark, folder), V.AS_OF)


@query("first_match_clusters_sharded", "WITH RECURSIVE " + V.ARTICLES_SQL + _first_sql("articles_v"))
def first_match_clusters_sharded(spark, folder):
    return L.first_match_cluster(V.articles(spark, folder), V.AS_OF)


_EMBEDDED_SQL = V.ONE_SHARD_SQL + """,
embedded_v AS (SELECT a.* REPLACE (CASE WHEN id % 6 = 0 THEN NULL ELSE category END AS category),
    CASE WHEN id % 12 = 0 THEN 'Elsewhere' ELSE 'National' END AS source_category, e.embedding::DOUBLE[] AS vector
  FROM one_shard_v a LEFT JOIN embeddings e ON e.vec_id = a.id AND a.id % 3 <> 1)"""


@query("first_match_embedded", "WITH RECURSIVE " + _EMBEDDED_SQL + _first_sql("embedded_v").replace(
    "SELECT id, category, state,", "SELECT id, category, coalesce(category, source_category) AS want, vector, state,").replace(
    "a.category IS NULL OR a.category = b.category", "a.want = b.category").replace(
    "par AS MATERIALIZED", """ve AS (SELECT p.a, p.b, round(list_dot_product(x.vector, y.vector) / sqrt(list_dot_product(x.vector, x.vector) * list_dot_product(y.vector, y.vector)), 12) AS sim
  FROM p JOIN k x ON x.id = p.a JOIN k y ON y.id = p.b WHERE x.vector IS NOT NULL AND y.vector IS NOT NULL),
both_sim AS MATERIALIZED (SELECT * FROM ve UNION ALL SELECT a, b, sim FROM n_sim ANTI JOIN ve USING (a, b)),
par AS MATERIALIZED""").replace("FROM n_sim s WHERE", "FROM both_sim s WHERE"))
def first_match_embedded(spark, folder):
    """First-match clusters by vectors where both articles have one; sources stand in for missing categories."""
    arts = V.one_shard(spark, folder)
    vectors = V.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding").filter("id % 3 <> 1")
    arts = arts.withColumn("category", F.when(F.col("id") % 6 != 0, F.col("category"))).withColumn(
        "source_category", F.when(F.col("id") % 12 == 0, "Elsewhere").otherwise("National"))
    return L.first_match_cluster(arts.join(vectors, "id", "left"), V.AS_OF)


@query("similar_embeddings", """
WITH v AS (SELECT min(vec_id) AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings GROUP BY embedding),
s AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 12) AS sim
  FROM v a JOIN v b ON a.id < b.id)
SELECT a, b, round(sim, 6) AS similarity FROM s WHERE sim >= 0.35""")
def similar_embeddings(spark, folder):
    return VJ.similar_vectors(V.table(spark, folder, "embeddings"), 0.35).withColumn("similarity", F.round("similarity", 6))


# --- sources and conflicts ---------------------------------------------------------------------------

def _citations(spark, folder):
    """Citations of ten consecutive cards as one cluster; their texts by text_id."""
    verified = V.sources(spark, folder).select("source_id", "verified_local_source")
    return (
        V.card_sources(spark, folder).join(verified, "source_id")
        .select(F.expr("card_id div 10").alias("cluster_id"), F.expr("card_id * 10 + ord").alias("ord"), "source_id", "name", "url", "trust_tier",
                "verified_local_source", F.when(F.col("card_id") % 6 == 0, "PTI").alias("wire"), F.col("article_id").alias("text_id"))
    )


def _cited_texts(spark, folder):
    return V.articles(spark, folder).select(F.col("id").alias("text_id"), F.concat_ws("\n", "title", "raw_text").alias("text"))


_CITATIONS_SQL = V.CARD_SOURCES_SQL + f""",
q_v AS MATERIALIZED (SELECT x.card_id // 10 AS cluster_id, x.card_id * 10 + x.ord AS id, x.source_id, x.name, x.url, x.trust_tier, s.verified_local_source,
  CASE WHEN x.card_id % 6 = 0 THEN 'PTI' END AS wire, {Q.publisher_entity('x.name', 'x.url')} AS entity,
  lower({Q.collapse("a.title || chr(10) || a.raw_text")}) AS t
  FROM card_sources_v x JOIN articles_v a ON a.id = x.article_id JOIN sources_v s ON s.source_id = x.source_id),
ok_v AS MATERIALIZED (SELECT * FROM q_v WHERE entity NOT IN {Q.in_list(K.UNRESOLVED_ENTITIES)}),
ip AS MATERIALIZED (SELECT l.id AS a, r.id AS b FROM ok_v l JOIN ok_v r ON l.cluster_id = r.cluster_id AND l.id < r.id),
{_terms('i', 'ok_v', 't')},
{_sims('i', pairs='ip')},
dep AS MATERIALIZED (SELECT ip.a, ip.b FROM ip JOIN ok_v l ON l.id = ip.a JOIN ok_v r ON r.id = ip.b LEFT JOIN i_sim s ON s.a = ip.a AND s.b = ip.b
  WHERE l.entity = r.entity OR l.source_id = r.source_id OR l.wire = r.wire OR coalesce(s.sim, 0) >= 0.70),
io AS MATERIALIZED (SELECT id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS n,
  coalesce((SELECT list(a) FROM dep WHERE dep.b = ok_v.id), []) AS before FROM ok_v),
iwalk AS (SELECT cluster_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS leaders FROM io GROUP BY 1
  UNION ALL SELECT o.cluster_id, o.n, CASE WHEN list_has_any(o.before, w.leaders) THEN w.leaders ELSE list_append(w.leaders, o.id) END
  FROM iwalk w JOIN io o ON o.cluster_id = w.cluster_id AND o.n = w.n + 1),
ilead AS MATERIALIZED (SELECT unnest(arg_max(leaders, n)) AS id FROM iwalk GROUP BY cluster_id),
group_v AS MATERIALIZED (SELECT o.id, o.cluster_id, CASE WHEN o.id IN (SELECT id FROM ilead) THEN o.id
  ELSE (SELECT min(a) FROM dep WHERE dep.b = o.id AND dep.a IN (SELECT id FROM ilead)) END AS group_ord FROM io o)"""


@query("source_groups", "WITH RECURSIVE " + _CITATIONS_SQL + " SELECT cluster_id, id AS ord, group_ord FROM group_v")
def source_groups(spark, folder):
    return L.source_groups(_citations(spark, folder), texts=_cited_texts(spark, folder))


@query("dependent_sources", "WITH RECURSIVE " + _CITATIONS_SQL + " SELECT cluster_id, id AS ord, group_ord FROM group_v WHERE id <> group_ord")
def dependent_sources(spark, folder):
    return C.source_pairs(_citations(spark, folder), _cited_texts(spark, folder))


@query("independent_counts", "WITH RECURSIVE " + _CITATIONS_SQL + " SELECT cluster_id, count(DISTINCT group_ord) AS independent_groups FROM group_v GROUP BY 1")
def independent_counts(spark, folder):
    return C.independent_counts(_citations(spark, folder), _cited_texts(spark, folder))


@query("valid_sources", "WITH " + V.CARD_SOURCES_SQL + f"""
SELECT DISTINCT card_id, {Q.publisher_entity('name', 'url')} AS entity FROM card_sources_v
WHERE {Q.publisher_entity('name', 'url')} NOT IN {Q.in_list(K.UNRESOLVED_ENTITIES)} AND trust_tier <> '3'""")
def valid_sources(spark, folder):
    return C.distinct_valid_sources(V.card_sources(spark, folder))


_FACT = r"(\d+(?:\.\d+)?)\s+([a-zA-Z]+)"
_CONFLICTS = f"""fact_v AS (SELECT cluster_id, unnest(regexp_extract_all(low, '{_FACT}', 2)) AS label,
  CAST(unnest(regexp_extract_all(low, '{_FACT}', 1)) AS DOUBLE) AS v FROM (
  SELECT id // 10 AS cluster_id, lower(title || ' ' || raw_text || ' ' || (id % 3 + 400) || ' staff and ' || CASE WHEN id // 10 % 3 = 0 THEN id % 7 + 2 ELSE 5 END || ' sites') AS low FROM articles_v)),
conflict_v AS (SELECT cluster_id, label, min(v) AS low, max(v) AS high FROM fact_v GROUP BY 1, 2
  HAVING count(*) >= 2 AND abs(max(v) - min(v)) / greatest(abs(min(v)), abs(max(v)), 1e-9) > 0.20)"""


def _fact_articles(spark, folder):
    planted = F.concat(F.lit(" "), (F.col("id") % 3 + 400).cast("string"), F.lit(" staff and "),
                       F.expr("if(id div 10 % 3 = 0, id % 7 + 2, 5)").cast("string"), F.lit(" sites"))
    return V.articles(spark, folder).select(F.expr("id div 10").alias("cluster_id"), "title", F.concat("raw_text", planted).alias("raw_text"))


@query("numeric_conflicts", "WITH " + V.ARTICLES_SQL + ", " + _CONFLICTS + """
SELECT cluster_id, label, round(low, 6) AS low, round(high, 6) AS high, 'Reports differ on ' || label AS note FROM conflict_v""")
def numeric_conflicts(spark, folder):
    return C.numeric_conflicts(_fact_articles(spark, folder)).withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


_SCOPE = "CASE WHEN cluster_id % 4 = 0 THEN 'local' ELSE 'national' END"


@query("evaluate_clusters", "WITH RECURSIVE " + _CITATIONS_SQL + ", " + _CONFLICTS + f""",
ev AS (SELECT cluster_id, count(*) AS source_count,
    count(*) FILTER (trust_tier = '1' AND id % 4 = 0 AND verified_local_source) AS official_local,
    count(*) FILTER (entity NOT IN {Q.in_list(K.UNRESOLVED_ENTITIES)}) AS valid_sources,
    coalesce(bool_or(entity NOT IN {Q.in_list(K.UNRESOLVED_ENTITIES)} AND NOT (trust_tier = '1' AND id % 4 = 0) AND trust_tier IN ('1', '2')), false) AS has_trusted
  FROM q_v GROUP BY 1),
gr AS (SELECT cluster_id, count(DISTINCT group_ord) AS g FROM group_v GROUP BY 1),
nt AS (SELECT cluster_id, string_agg('Reports differ on ' || label, ';' ORDER BY 'Reports differ on ' || label) AS notes FROM conflict_v GROUP BY 1),
z AS (SELECT ev.*, coalesce(g, 0) AS g, notes, {_SCOPE} AS scope FROM ev LEFT JOIN gr USING (cluster_id) LEFT JOIN nt USING (cluster_id))
SELECT cluster_id, source_count, valid_sources, g AS independent_groups,
  (scope = 'local' AND official_local >= 1) OR (valid_sources >= 2 AND g >= 2 AND has_trusted) AS eligible,
  notes IS NOT NULL AS flagged_conflict, coalesce(notes, '') AS conflict_notes,
  CASE WHEN notes IS NOT NULL THEN 'flagged_conflict' WHEN scope = 'local' AND official_local = 1 AND source_count = 1 THEN 'official_source'
    WHEN g < 2 THEN 'single_source' ELSE 'cross_verified' END AS verification_type FROM z""")
def evaluate_clusters(spark, folder):
    """Eligibility, conflict flags and verification type per cluster."""
    cites = _citations(spark, folder).withColumn("trust_tier", F.when(
        (F.col("trust_tier") == "1") & (F.col("ord") % 4 == 0), "official_local").otherwise(F.col("trust_tier")))
    facts = _fact_articles(spark, folder)
    scopes = cites.select("cluster_id").distinct().selectExpr("cluster_id", "if(cluster_id % 4 = 0, 'local', 'national') as scope")
    out = C.evaluate_clusters(cites, facts, scopes, _cited_texts(spark, folder))
    return out.withColumn("conflict_notes", F.array_join("conflict_notes", ";"))

