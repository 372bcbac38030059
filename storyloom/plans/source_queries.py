"""Landed payloads, pages, summaries, language tags and streams."""

from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions.language import language_profiles, tag_language
from storyloom.functions.text import collapse
from storyloom.operators import summaries as Y
from storyloom.plans import fixtures as V
from storyloom.plans import sqltext as Q
from storyloom.plans.cluster_queries import _leader_sql as leader_sql
from storyloom.plans.registry import query
from storyloom.session import shared_folder
from storyloom.sources import articles as SA
from storyloom.sources import pages as P
from storyloom.sources import payloads as N
from storyloom.streaming import flows as T
from storyloom.streaming import leaders as TL


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _payload(spark, folder, path, fields):
    """Articles grouped into provider answers of up to ten items."""
    arts = V.articles(spark, folder)
    item = F.struct(*[c.alias(n) for n, c in fields.items()])
    doc = F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("id", item.alias("item"))))["item"].alias(path)))
    return arts.groupBy(F.expr("id div 10").alias("call")).agg(doc.alias("payload"))




def _iso():
    return F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")


_BASE = "WITH " + V.ARTICLES_SQL


def _shaped(body):
    return (f" SELECT url, {Q.strip('title')} AS title, {body} AS raw_text, {Q.stamp('published_at')} AS published_at "
            "FROM articles_v")


_TRIM = Q.strip("raw_text")


def _shape(df):
    return df.select("url", "title", "raw_text", stamp("published_at").alias("published_at"))


@query("from_newsdata", _BASE + _shaped(
    f"CASE WHEN id % 3 = 0 AND {Q.strip('title')} <> {_TRIM} THEN {Q.strip('title')} || chr(10) || chr(10) || {_TRIM} WHEN id % 3 <> 2 THEN {_TRIM} ELSE {Q.strip('title')} END"))
def from_newsdata(spark, folder):
    m = F.col("id") % 3
    return _shape(N.from_newsdata(_payload(spark, folder, "results", {
        "link": F.col("url"), "title": F.col("title"), "description": F.when(m != 1, F.col("title")),
        "content": F.when(m != 2, F.col("raw_text")), "pubDate": _iso()})))


@query("from_currents", _BASE + _shaped(
    f"CASE WHEN id % 2 = 0 THEN {Q.strip('title')} ELSE {_TRIM} END"))
def from_currents(spark, folder):
    even = F.col("id") % 2 == 0
    return _shape(N.from_currents(_payload(spark, folder, "news", {
        "url": F.col("url"), "title": F.col("title"), "description": F.when(even, F.col("title")),
        "content": F.col("raw_text"), "published": _iso()})))


@query("from_newsapi", _BASE + _shaped(
    f"{Q.strip('title || chr(10) || chr(10) || raw_text')}"))
def from_newsapi(spark, folder):
    return _shape(N.from_newsapi(_payload(spark, folder, "articles", {
        "url": F.col("url"), "title": F.col("title"), "description": F.col("title"), "content": F.col("raw_text"),
        "publishedAt": _iso()})))


@query("from_serpapi", _BASE + _shaped(
    f"CASE WHEN id % 2 = 0 THEN {Q.strip('title')} ELSE {_TRIM} END"))
def from_serpapi(spark, folder):
    return _shape(N.from_serpapi(_payload(spark, folder, "news_results", {
        "link": F.col("url"), "title": F.col("title"), "snippet": F.when(F.col("id") % 2 == 0, " ").otherwise(F.col("raw_text")),
        "date": _iso()})))


@query("from_gdelt", _BASE + f" SELECT url, {Q.strip('title')} AS title, '20240131T101500Z' AS raw_text, CAST(NULL AS VARCHAR) AS published_at FROM articles_v")
def from_gdelt(spark, folder):
    return _shape(N.from_gdelt(_payload(spark, folder, "articles", {
        "url": F.col("url"), "title": F.col("title"), "seendate": F.lit("20240131T101500Z")})))


def _feeds(spark, folder):
    """Articles written out as one RSS document per source."""
    arts = V.articles(spark, folder).filter("published_at is not null")
    item = F.concat(
        F.lit("<item><title>"), F.col("title"), F.lit(" - "), F.col("source_id"), F.lit("</title><link>"), F.col("url"),
        F.lit("?utm_source=rss</link><description><![CDATA[<p>"), F.col("raw_text"), F.lit("</p>]]></description><pubDate>"),
        F.date_format("published_at", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    return arts.groupBy("source_id", "category").agg(F.array_join(F.sort_array(F.collect_list(
        F.struct("id", item.alias("x"))))["x"], "\n").alias("items")).select(
        F.concat("source_id", F.lit("/"), "category").alias("feed"), "category",
        F.concat(F.lit("<rss><channel><title>Feed</title>"), "items", F.lit("</channel></rss>")).alias("xml"))


@query("parse_feeds", _BASE + f"""
SELECT source_id || '/' || category AS feed, url, {Q.strip("title || ' - ' || source_id")} AS title, {_TRIM} AS raw_text, {Q.stamp('published_at')} AS published_at
FROM articles_v WHERE published_at IS NOT NULL""")
def parse_feeds(spark, folder):
    return N.parse_feeds(_feeds(spark, folder), keep=["feed"]).select(
        "feed", "url", "title", "raw_text", stamp("published_at").alias("published_at"))


@query("crawl_entries", _BASE + r"""
SELECT source_id || '/' || category AS feed, url, regexp_replace(t, '\s+-\s+[^-]+$', '') AS title, source_id AS source, category FROM (
  SELECT *, regexp_replace(title || ' - ' || source_id, '^\s+|\s+$', '', 'g') AS t FROM articles_v WHERE published_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY source_id, category ORDER BY id) <= 4)""")
def crawl_entries(spark, folder):
    rows = N.parse_feeds(_feeds(spark, folder), keep=["feed", "category"])
    return N.crawl_entries(rows, "feed", F.lit("Desk"), 4).select("feed", "url", "title", "source", "category")


@query("live_entries", _BASE + rf"""
, e AS (SELECT source_id || '/' || category AS feed, url, id, published_at, trim(regexp_replace({Q.strip("title || ' - ' || source_id")}, '\s+-\s+[^-]+$', '')) AS title
  FROM articles_v WHERE published_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id, category ORDER BY id) <= 5),
w AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS k FROM e WHERE published_at >= TIMESTAMP '{V.AS_OF}' - INTERVAL 72 HOURS)
SELECT feed, url, title FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY feed, id) = 1""")
def live_entries(spark, folder):
    rows = N.parse_feeds(_feeds(spark, folder), keep=["feed", "category"])
    return N.live_entries(rows, V.AS_OF, "feed", F.lit("Desk"), 5).select("feed", "url", "title")


_NODE = r"""coalesce(nullif(regexp_extract(b, '(?is)<article\b[^>]*>(.*?)(?:</article>|$)', 1), ''), regexp_extract(b, '(?is)<body\b[^>]*>(.*?)(?:</body>|$)', 1))"""


@query("extract_body", f"""
WITH {Q.REFERENCES}
SELECT page_id, {Q.collapse(Q.decode("regexp_replace(" + _NODE + ", '<[^>]+>', ' ', 'g')"))} AS body
FROM (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g') AS b FROM pages), refs""")
def extract_body(spark, folder):
    """Whole text of the content node; storage cuts are left to the caller."""
    return V.table(spark, folder, "pages").select("page_id", P.extract_body("html", None).alias("body"))


@query("extract_meta", f"""
WITH {Q.REFERENCES}
SELECT page_id, {Q.strip(Q.decode("regexp_extract(html, '(?is)<h1[^>]*>([^<]*)', 1)"))} AS title,
  'Teaser &' AS summary, 'Lead ' || page_id || ' goes on. Nested & deep' AS content, 'Desk ' || page_id AS author, '2024-01-05 10:00:00' AS published_at FROM pages, refs""")
def extract_meta(spark, folder):
    """Title, teaser, paragraphs, author and date of pages; tags and a nested content node are planted, the article node is renamed."""
    number = F.col("page_id").cast("string")
    pages = V.table(spark, folder, "pages").select("page_id", F.concat(
        F.lit('<meta property="og:description" content="Teaser &amp;"><meta content="Desk '), number,
        F.lit('" name="author"><meta property="article:published_time" content="2024-01-05T10:00:00Z">'
              '<div class="wide content"><div><p>Lead '), number,
        F.lit(' <b>in <i>bold</i></b> goes on.</p></div><div><div></div><p> Nested &amp; deep</p></div></div><p>outside</p>'),
        F.regexp_replace("html", "<(/?)article", "<$1section")).alias("html"))
    return N.extract_meta(pages, keep=["page_id"]).select("page_id", "title", "summary", "content", "author", stamp("published_at").alias("published_at"))


_LI = r"(?is)<li[^>]*>\s*<a[^>]*>(.*?)</a>"
_HEADLINE = Q.collapse(Q.replace_all("replace(regexp_replace(" + Q.unescape("h") + ", '<[^>]+>', ' ', 'g'), '&nbsp;', ' ')", [
    ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", " - "), (" ", " "), ("�", "'")]))


@query("explode_coverage", f"""
SELECT page_id, item_pos, {_HEADLINE} AS headline, '' AS publisher FROM (
  SELECT page_id, unnest(l) AS h, CAST(unnest(range(len(l))) AS BIGINT) AS item_pos FROM (SELECT page_id, regexp_extract_all(html, '{_LI}', 1) AS l FROM pages))
WHERE {_HEADLINE} <> ''""")
def explode_coverage(spark, folder):
    return N.explode_coverage(V.table(spark, folder, "pages"), keep=["page_id"]).select(
        "page_id", F.col("item_pos").cast("bigint").alias("item_pos"), "headline", "publisher")


@query("coverage_summary", f"""
WITH i AS (SELECT page_id, unnest(l) AS h, unnest(range(len(l))) AS item_pos FROM (SELECT page_id, regexp_extract_all(html, '{_LI}', 1) AS l FROM pages)),
c AS (SELECT page_id, item_pos, {_HEADLINE} AS headline FROM i)
SELECT page_id, string_agg(headline, '. ' ORDER BY item_pos) || '.' AS summary FROM c WHERE item_pos BETWEEN 1 AND 3 AND headline <> '' AND lower(headline) <> 'en' GROUP BY 1""")
def coverage_summary(spark, folder):
    rows = N.explode_coverage(V.table(spark, folder, "pages"), keep=["page_id"]).withColumn("title", F.lit("EN"))
    return N.coverage_summary(rows, "page_id")


# --- summaries -------------------------------------------------------------------------------

def _snippet_sql():
    s = Q.strip("regexp_replace(" + Q.clean_text("raw_text") + r", '\s+-\s+[^-]+$', '')")
    rest = "regexp_replace(substring(s, length(lead) + 1), '^[ .\\-:\\t\\n]+|[ .\\-:\\t\\n]+$', '', 'g')"
    return s, f"""CASE WHEN s = '' OR lower(s) = lower(lead) THEN NULL
    WHEN starts_with(lower(s), lower(lead)) THEN CASE WHEN length({rest}) > 15 THEN {rest} END
    WHEN NOT contains(lower(s), lower(lead)) THEN s WHEN length(s) > length(lead) + 15 THEN s END"""


_S, _SNIP = _snippet_sql()


@query("extractive_summaries", _BASE + ", " + V.SOURCES_SQL + f""",
a AS MATERIALIZED (SELECT id // 4 AS cluster_id, id, {Q.clean_text('title')} AS t, s.name AS source, {_S} AS s, a.category FROM articles_v a JOIN sources_v s USING (source_id)),
l AS (SELECT cluster_id, arg_min(t, id) AS lead, arg_min(category, id) AS cat FROM a GROUP BY 1),
n AS (SELECT cluster_id, source, min(id) AS o FROM a GROUP BY 1, 2),
m AS (SELECT cluster_id, count(*) AS n, (list(source ORDER BY o))[1:3] AS names FROM n GROUP BY 1),
p AS (SELECT cluster_id, snip, min(id) AS o FROM (SELECT a.cluster_id, id, {_SNIP} AS snip FROM a JOIN l USING (cluster_id)) WHERE snip IS NOT NULL GROUP BY 1, 2),
q AS (SELECT cluster_id, (list(snip ORDER BY o))[1:3] AS sn FROM p GROUP BY 1),
z AS (SELECT l.*, m.n, array_to_string(names, ', ') AS src, names[1] AS one, coalesce(sn, []) AS sn FROM l JOIN m USING (cluster_id) LEFT JOIN q USING (cluster_id))
SELECT cluster_id, substring(lead, 1, 100) AS headline,
  CASE WHEN len(sn) = 0 THEN lead || '. Reported by ' || src || '.' ELSE
    array_to_string(list_concat([CASE WHEN contains(lower(sn[1]), lower(lead)) THEN sn[1] ELSE lead || '. ' || sn[1] END], sn[2:3]), chr(10) || chr(10)) END AS summary,
  array_to_string(list_concat([substring(lead, 1, 100), CASE WHEN n > 1 THEN 'Corroborated across ' || n || ' sources: ' || src || '.' ELSE 'Reported by ' || one || '.' END],
    list_transform(sn[1:2], lambda x: substring(x, 1, 100)), ['Category: ' || cat])[1:3], ' | ') AS key_facts FROM z""")
def extractive_summaries(spark, folder):
    arts = V.articles(spark, folder).join(V.sources(spark, folder).select("source_id", F.col("name").alias("source")), "source_id").select(
        F.expr("id div 4").alias("cluster_id"), F.col("id").alias("ord"), "title", "source", F.col("raw_text").alias("summary"), "category")
    return Y.extractive_summaries(arts).withColumn("key_facts", F.array_join("key_facts", " | "))


@query("article_summary", _BASE + f""",
t AS (SELECT id, source_id, state, {Q.strip("regexp_replace(title, '" + chr(92) + "s+-" + chr(92) + "s+[^-]+$', '')")} AS h,
  {Q.strip("regexp_replace(" + Q.strip('raw_text') + ", '" + chr(92) + "s+-" + chr(92) + "s+[^-]+$', '')")} AS c FROM articles_v)
SELECT id, CASE WHEN length(c) > 15 AND lower(c) <> lower(h) AND NOT contains(lower(c), lower(h)) THEN h || '. ' || c
  WHEN length(c) > 15 AND lower(c) <> lower(h) THEN c ELSE 'Reporting from ' || source_id || ': ' || h || '.' END AS summary,
  CASE WHEN length(c) > 20 AND lower(c) <> lower(h) THEN substring(c, 1, 100) ELSE 'Region: ' || coalesce(state, 'National') END AS last_fact FROM t""")
def article_summary(spark, folder):
    out = Y.article_summary(F.col("title"), F.col("raw_text"), F.col("source_id"), F.col("state"))
    return V.articles(spark, folder).select("id", out.alias("x")).select("id", "x.summary", F.get("x.key_facts", F.lit(2)).alias("last_fact"))


_LIVE = Q.strip(r"regexp_replace(title, '\s+-\s+[^-]+$', '')")


@query("live_summary", _BASE + f""",
t AS (SELECT id, source_id AS src, state, {_LIVE} AS h, {_HEADLINE} AS c0 FROM (SELECT * REPLACE ({Q.collapse('title')} AS title), raw_text AS h FROM articles_v)),
u AS (SELECT *, CASE WHEN contains(c0, ' - ') THEN {Q.strip("regexp_replace(c0, '" + chr(92) + "s+-" + chr(92) + "s+[^-]+$', '')")} ELSE c0 END AS c1 FROM t),
v AS (SELECT *, CASE WHEN starts_with(lower(c1), lower(h)) THEN {Q.strip("regexp_replace(" + Q.strip("substring(c1, length(h) + 1)") + ", '^[.:" + chr(92) + "-–—," + chr(92) + "s]+', '')")} ELSE c1 END AS c FROM u)
SELECT id, CASE WHEN id % 5 = 0 THEN 'According to verified reports across Desk A, ' || src || ', Angle ' || id || '. Further developments reported that Other angle & more.'
    WHEN id % 5 = 1 THEN 'Verified reporting dispatched by ' || src || '. Comprehensive background and wire telemetry are documented in the source dossier.'
    WHEN length(c) > 25 AND lower(c) <> lower(h) THEN c
    WHEN state IS NOT NULL THEN 'Reported from regional bureaus across ' || state || ' by ' || src || '.'
    ELSE 'Verified news report dispatched by ' || src || '. Review the source dossier for complete reporting details.' END AS summary,
  CASE WHEN id % 5 = 0 THEN 'Angle ' || id || ' (Desk A) | Other angle & more | Corroborated across: Desk A, ' || src
    WHEN id % 5 = 1 THEN 'Corroborated across: ' || src
    ELSE substring(h, 1, 110) || ' | Source: ' || src || ' | Region: ' || coalesce(state, 'National / Global') END AS facts FROM v""")
def live_summary(spark, folder):
    """Live summaries; a fifth of the snippets are coverage lists, another fifth lists that say nothing new."""
    item = lambda head, pub="": F.concat(F.lit('<li><a href="x">'), head, F.lit("</a>"), F.lit(f"&nbsp;<font>{pub}</font>" if pub else ""), F.lit("</li>"))
    markup = F.when(F.col("id") % 5 == 0, F.concat(item(F.col("title")), item(F.concat(F.lit("Angle "), F.col("id").cast("string")), "Desk A"),
                                                   item(F.lit("Other angle &amp; more")))).when(F.col("id") % 5 == 1, item(F.col("title")))
    out = Y.live_summary(F.col("title"), F.col("raw_text"), F.col("source_id"), F.col("state"), N.coverage_items(markup))
    return V.articles(spark, folder).withColumn("title", collapse("title")).select("id", out.alias("x")).select("id", "x.summary", F.array_join("x.key_facts", " | ").alias("facts"))


@query("tag_language", rf"""
WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM documents),
c AS (SELECT lang, word, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2),
r AS (SELECT lang, word, n / sum(n) OVER (PARTITION BY lang) AS rate FROM c),
t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY lang ORDER BY rate DESC, word) <= 200),
p AS (SELECT lang, word, round(rate / sum(rate) OVER (PARTITION BY word), 6) AS weight FROM t),
v AS (SELECT doc_id, p.lang, round(sum(weight), 6) AS score FROM w JOIN p USING (word) GROUP BY 1, 2),
b AS (SELECT doc_id, first(lang ORDER BY score DESC, lang) AS best FROM v GROUP BY 1)
SELECT doc_id, coalesce(best, 'en') AS detected_lang, CASE WHEN coalesce(best, 'en') = 'en' THEN 'keep' ELSE 'translate' END AS lane
FROM documents LEFT JOIN b USING (doc_id)""")
def tag_language_query(spark, folder):
    docs = V.table(spark, folder, "documents")
    return tag_language(docs.select("doc_id", "text"), language_profiles(docs), "doc_id", F.col("text")).select(
        "doc_id", "detected_lang", "lane")


# --- streams, drained over the landed files ------------------------------------------------------

def _flow_folder(spark):
    import uuid

    return f"{shared_folder(spark)}/flow-{uuid.uuid4().hex}"


def _drained(spark, stream, name):
    return T.drain(stream, name, _flow_folder(spark))


def _stream(spark, folder, name):
    V.pin_session(spark)
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # a stream reads folders: the table's own, or that of its one file, where the others are left out
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema)
    df = reader.parquet(f"{folder}/{name}.parquet") if whole else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    for field in schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


@query("stream_dedup_urls", r"""
SELECT u AS url FROM (SELECT DISTINCT regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', '') AS u FROM pages)""")
def stream_dedup_urls(spark, folder):
    stream = _stream(spark, folder, "pages").withColumn("url", F.regexp_extract("url", r"^([^?#]*)", 1)).withColumn(
        "ingested_at", F.timestamp_seconds(F.lit(1706659200) + F.col("page_id")))
    return _drained(spark, T.dedup_urls(T.normalized(stream)).select("url"), "urls")


@query("stream_ingest", r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', '') AS url, page_id % 4 AS lane FROM pages)
SELECT url, arg_min(page_id, (lane, page_id)) AS page_id FROM p GROUP BY 1""")
def stream_ingest(spark, folder):
    """Addresses, with the page that brings each, that a stream of four batches adds; the query is stopped after the second and started again."""
    at = _flow_folder(spark)
    pages = V.table(spark, folder, "pages").select("page_id", F.regexp_extract("url", r"^([^?#]*)", 1).alias("url"))
    for lanes in ((0, 1), (2, 3)):
        for lane in lanes:
            pages.filter(F.col("page_id") % 4 == lane).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = T.normalized(T.read_landed(spark, f"{at}/in", pages.schema, files_per_batch=1))
        T.ingest_batches(stream, f"{at}/out", f"{at}/state", order=["page_id"], availableNow=True).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("url", "page_id")


@query("stream_run_metrics", "WITH " + V.RUNS_SQL + """,
d AS (SELECT date_trunc('day', timestamp) AS day, * FROM runs_v)
SELECT strftime(day, '%Y-%m-%d %H:%M:%S') AS day, provider, count(*) AS runs, CAST(sum(articles_ingested) AS BIGINT) AS articles,
  CAST(sum(greatest(0, credits_used)) AS BIGINT) AS credits, CAST(sum(len(errors)) AS BIGINT) AS errors FROM d
WHERE day + INTERVAL 1 DAY <= (SELECT max(timestamp) - INTERVAL 1 HOUR FROM runs_v) GROUP BY d.day, provider""")
def stream_run_metrics(spark, folder):
    """Daily sums of the days the watermark has passed."""
    runs = _stream(spark, folder, "events").selectExpr(
        "event_type as provider", "ts as timestamp", "cast(floor(value) as bigint) - 2 as credits_used",
        "cast(user_id % 4 as bigint) as articles_ingested", "if(event_type = 'error', array(props), array()) as errors")
    out = _drained(spark, T.run_metrics(runs), "metrics")
    return out.select(stamp("day").alias("day"), "provider", "runs", "articles", "credits", "errors")


@query("stream_sessions", """
WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e),
g AS (SELECT user_id, k, min(ts) AS started, max(ts) + INTERVAL 30 MINUTES AS ended, count(*) AS events FROM s GROUP BY 1, 2)
SELECT user_id, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, events FROM g WHERE ended <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark, folder):
    out = _drained(spark, T.sessions(_stream(spark, folder, "events")), "sessions")
    return out.select("user_id", stamp("started").alias("started"), "events")


def _article_stream(spark, folder):
    docs = _stream(spark, folder, "documents")
    return docs.selectExpr(
        "doc_id as id", "array_join(slice(split(text, ' '), 1, 12), ' ') as title", "text as summary", "source",
        "if(doc_id % 97 = 0, null, timestamp_seconds(1706400000 + ((doc_id * 37) % 5760) * 60)) as published_at",
        "timestamp_seconds(1706659200 + doc_id) as ingested_at")


@query("stream_late_rows", _BASE + f"""
SELECT CASE WHEN published_at >= TIMESTAMP '{V.AS_OF}' - INTERVAL 72 HOURS THEN 'kept' ELSE 'side' END AS lane, id FROM articles_v""")
def stream_late_rows(spark, folder):
    kept, late = T.split_late(_article_stream(spark, folder).select("id", "published_at"), V.AS_OF)
    return _drained(spark, kept, "kept").select(F.lit("kept").alias("lane"), "id").union(
        _drained(spark, late, "late").select(F.lit("side").alias("lane"), "id"))


@query("stream_topics", rf"""
WITH w AS (SELECT TIMESTAMP '2024-01-31 00:00:00' + to_minutes(doc_id) AS ts, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS topic FROM documents),
f AS (SELECT * FROM w WHERE regexp_matches(topic, '^[A-Z][a-zA-Z0-9]{{2,}}$') AND lower(topic) NOT IN {Q.in_list(K.TREND_STOPWORDS)}),
h AS (SELECT topic, date_trunc('hour', ts) + to_hours(k) AS until FROM f, (SELECT unnest(range(1, 25)) AS k))
SELECT {Q.stamp('until')} AS until, topic, count(*) AS mentions FROM h GROUP BY until, topic""")
def stream_topics(spark, folder):
    """Mentions of all topics in all sliding day windows, those that are not over yet too."""
    cards = _article_stream(spark, folder).select(
        F.timestamp_seconds(F.lit(1706659200) + F.col("id") * 60).alias("created_at"), F.lit("").alias("headline"), "summary")
    out = T.drain_complete(T.sliding_topics(cards), "topics", _flow_folder(spark))
    return out.select(stamp("until").alias("until"), "topic", "mentions")


@query("article_files", """
WITH r AS (SELECT doc_id, 'https://x.org/' || doc_id // 2 AS link, CASE WHEN doc_id % 3 = 0 THEN 'array' ELSE 'lines' END AS kind FROM documents),
g AS (SELECT link, arg_min(doc_id, (kind, doc_id)) AS doc_id FROM r WHERE doc_id % 5 <> 4 GROUP BY 1)
SELECT 'record' AS kind, link, 'title ' || doc_id AS text FROM g
UNION ALL SELECT 'broken', NULL, '{"link": ' || doc_id FROM r WHERE kind = 'lines' AND doc_id % 5 = 4""")
def article_files(spark, folder):
    """Records and broken lines of landed article files: JSON arrays in one folder, JSON lines in the other."""
    at = _flow_folder(spark)
    docs = V.table(spark, folder, "documents").select("doc_id", F.to_json(F.struct(
        F.concat(F.lit("https://x.org/"), F.expr("doc_id div 2").cast("string")).alias("link"),
        F.concat(F.lit("title "), F.col("doc_id").cast("string")).alias("title"))).alias("value"))
    broken, third = F.col("doc_id") % 5 == 4, F.col("doc_id") % 3 == 0
    arrays = docs.filter(third & ~broken).groupBy(F.expr("doc_id div 600").alias("file")).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("doc_id", "value")))["value"], ",\n").alias("value"))
    arrays.select(F.concat(F.lit("[\n"), "value", F.lit("\n]")).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{at}/array")
    docs.filter(~third).repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(
        F.when(broken, F.concat(F.lit('{"link": '), F.col("doc_id").cast("string"))).otherwise(F.col("value")).alias("value")) \
        .write.text(f"{at}/lines")
    good, bad = SA.read_articles(spark, [f"{at}/array", f"{at}/lines"])
    return good.select(F.lit("record").alias("kind"), "link", F.col("title").alias("text")).unionByName(
        bad.select(F.lit("broken").alias("kind"), F.lit(None).cast("string").alias("link"), "text"))


@query("stream_match_window", """
WITH a AS (SELECT doc_id AS id, source, TIMESTAMP '2024-01-28 00:00:00' + to_minutes(CAST((doc_id * 37) % 5760 AS INT)) AS at FROM documents),
b AS (SELECT doc_id AS id, lower(string_split(text, ' ')[1]) AS block FROM documents)
SELECT a.id, c.id AS other FROM a JOIN b ON a.id = b.id JOIN b d ON d.block = b.block AND d.id < b.id JOIN a c ON c.id = d.id AND c.source = a.source
WHERE abs(epoch(a.at) - epoch(c.at)) <= 129600""")
def stream_match_window(spark, folder):
    """Pairs of articles of a source that open with the same word within 36 hours."""
    def side():
        return _stream(spark, folder, "documents").selectExpr(
            "doc_id as id", "source as shard", "lower(split(text, ' ')[0]) as block",
            "timestamp_seconds(1706400000 + ((doc_id * 37) % 5760) * 60) as at")

    return _drained(spark, T.match_window(side(), side()), "pairs").select("id", "other")


@query("fan_out", _BASE + """
SELECT c_custkey AS chat_id, id FROM customer, (SELECT id FROM articles_v ORDER BY ingested_at DESC, id DESC LIMIT 5)""")
def fan_out(spark, folder):
    items = V.articles(spark, folder).select("id", "title", F.col("ingested_at").alias("fetched_at"))
    chats = V.table(spark, folder, "customer").select(F.col("c_custkey").alias("chat_id"))
    return T.fan_out(items, chats).select("chat_id", "id")


@query("fetch_status", "WITH " + V.RUNS_SQL + f"""
SELECT provider AS source, {Q.stamp('max(timestamp)')} AS last_fetched_at, arg_max(articles_ingested, timestamp) AS items_found FROM runs_v GROUP BY 1""")
def fetch_status(spark, folder):
    runs = V.runs(spark, folder).select(F.col("provider").alias("source"), F.col("timestamp").alias("last_fetched_at"),
                                        F.col("articles_ingested").alias("items_found"), "run_id")
    out = T.fetch_status(runs.filter("run_id % 2 = 0"), runs.filter("run_id % 2 = 1"))
    return out.select("source", stamp("last_fetched_at").alias("last_fetched_at"), "items_found")


@query("stream_fan_out", _BASE + """
SELECT c_custkey AS chat_id, id FROM customer, (SELECT id FROM articles_v ORDER BY ingested_at DESC, id DESC LIMIT 5)""")
def stream_fan_out(spark, folder):
    """New items of a stream for every subscriber; all files land in one batch."""
    items = _article_stream(spark, folder).select("id", "title", F.col("ingested_at").alias("fetched_at"))
    chats = V.table(spark, folder, "customer").select(F.col("c_custkey").alias("chat_id"))
    at = _flow_folder(spark)
    T.fan_out_batches(items, chats, f"{at}/out", f"{at}/state", availableNow=True).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("chat_id", "id")


@query("stream_fetch_status", "WITH " + V.RUNS_SQL + f"""
SELECT provider AS source, {Q.stamp('max(timestamp)')} AS last_fetched_at, arg_max(articles_ingested, timestamp) AS items_found FROM runs_v GROUP BY 1""")
def stream_fetch_status(spark, folder):
    """Latest status per source that a stream of runs leaves."""
    runs = _stream(spark, folder, "events").selectExpr(
        "event_type as source", "ts as last_fetched_at", "cast(user_id % 4 as bigint) as items_found", "event_id as run_id")
    at = _flow_folder(spark)
    T.status_batches(runs, f"{at}/out", f"{at}/state", availableNow=True).awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    last = out.agg(F.max("batch_no")).collect()[0][0]
    return out.filter(F.col("batch_no") == last).select("source", stamp("last_fetched_at").alias("last_fetched_at"), "items_found")


def _landed(spark, df, at, lane, parts):
    """Rows written as files that land one after the other, by the number in ``lane``, and a stream of one file per batch."""
    for i in range(parts):
        df.filter(lane == i).coalesce(1).write.mode("append").parquet(f"{at}/in")
    return T.read_landed(spark, f"{at}/in", df.schema, files_per_batch=1)


# a seventh of the articles lands last, after later ones; the rest in three batches
_LATE = "CASE WHEN id % 7 = 0 THEN 3 ELSE id % 9 // 3 END"
_STREAM_SQL = V.ONE_SHARD_SQL + f""",
arrived_v AS (SELECT id AS own, row_number() OVER (ORDER BY {_LATE}, ingested_at, id) AS n FROM one_shard_v),
stream_v AS (SELECT * REPLACE (n AS id) FROM one_shard_v JOIN arrived_v ON own = id)"""


@query("stream_leaders", "WITH RECURSIVE " + _STREAM_SQL + leader_sql("stream_v").replace(
    "SELECT x.id, coalesce(best.cluster_id, x.id) AS cluster_id, round(best.sim, 6) AS similarity FROM x LEFT JOIN best USING (id)",
    """SELECT m.own AS id, l.own AS cluster_id, round(best.sim, 6) AS similarity FROM x LEFT JOIN best USING (id)
  JOIN arrived_v m ON m.n = x.id JOIN arrived_v l ON l.n = coalesce(best.cluster_id, x.id)"""))
def stream_leaders(spark, folder):
    """Leader clusters of a stream in four batches; late and undated rows meet the leaders that are stored by then."""
    at = _flow_folder(spark)
    rows = V.one_shard(spark, folder).withColumnRenamed("raw_text", "summary").select(
        "id", "title", "summary", "category", "state", "district", "published_at", "ingested_at")
    lane = F.when(F.col("id") % 7 == 0, 3).otherwise(F.expr("id % 9 div 3"))
    out = T.drain(TL.assign_leaders(_landed(spark, rows, at, lane, 4)), "leaders", at)
    return out.select("id", "cluster_id", F.round("similarity", 6).alias("similarity"))
