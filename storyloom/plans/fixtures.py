"""News-shaped views over the driver tables, for Spark and as SQL text.

Both forms follow the same rules, so that a query over the Spark view can be
checked against plain SQL over the same Parquet files.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.session import pin_session

AS_OF = "2024-02-01 00:00:00"

STATE_NAMES = K.STATES + K.UNION_TERRITORIES
SOURCE_NAMES = [
    "The Hindu", "BBC News", "Reuters", "NDTV", "Hindustan Times", "Local Wire", "Press Trust of India",
    "Livemint", "Unresolved Desk", "Amar Ujala", "The Verge", "Hill Post", "Associated Press",
]
SOURCE_HOSTS = [
    "www.thehindu.com", "www.bbc.co.uk", "www.reuters.com", "news.google.com", "www.nytimes.com",
    "localwire.example.com", "pti.example.com", "www.livemint.com", "desk.example.org",
    "www.amarujala.com", "www.theverge.com", "hillpost.example.net", "apnews.com",
]


# Phrases planted behind headlines, one per card, so that keyword rules fire.
PHRASES = [
    "Cyclone strikes coast, thousands displaced", "Union Cabinet approves tax bill", "Ransomware hits regional power grid",
    "Malware halts hospital networks", "Pipeline maintenance in Ward 4", "Veteran actor dies aged 82",
    "Earthquake leaves hundreds dead", "Celebrity at fashion show", "Mandatory evacuation after chemical spill",
    "Evacuation drills planned", "Bike accident on highway, one dead", "Floods claim 1,385 lives",
    "At least 25 people have died in train derailment", "Five killed in crash", "Market crash deepens recession",
    "Law passed by parliament", "Search and rescue continues", "Investigation ongoing, probe ordered",
    "Anniversary editorial", "Breaking: verdict delivered today", "Weapons recovered near border",
    "Historic treaty, permanent shift", "Stock exchange sees quarterly profit", "Storm alert sounded",
    "Museum opens painting exhibition", "Routine notes", "Hostage taken, death toll rises", "Bilateral pact signed",
    "Stabbed in fight, suspect held",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    pin_session(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return spread(df) if name in TEXT_TABLES else df


TEXT_TABLES = ("documents", "pages")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when a scan gives fewer splits than there are cores.

    Text work is bound by the processor; one small file would leave it to one
    core.  Large tables have splits enough and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _spark_list(values) -> str:
    return "array(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")"


def _duck_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def articles(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents")
    number = "cast(substr(source, 4) as int)"
    return docs.selectExpr(
        "doc_id as id",
        "source as source_id",
        f"concat('https://', element_at({_spark_list(SOURCE_HOSTS)}, {number} % {len(SOURCE_HOSTS)} + 1), "
        "'/story/', doc_id) as url",
        "array_join(slice(split(text, ' '), 1, 12), ' ') as title",
        "text as raw_text",
        f"element_at({_spark_list(K.PRIMARY_CATEGORIES)}, cast(doc_id % 10 + 1 as int)) as category",
        f"if(doc_id % 4 = 0, null, element_at({_spark_list(STATE_NAMES)}, cast(doc_id % 36 + 1 as int))) as state",
        "if(doc_id % 5 = 0, 'pune', cast(null as string)) as district",
        "if(doc_id % 97 = 0, null, timestamp_seconds(1706400000 + ((doc_id * 37) % 5760) * 60)) as published_at",
        "timestamp_seconds(1706659200 + doc_id) as ingested_at",
        "lang",
    )


ARTICLES_SQL = f"""articles_v AS (
  SELECT doc_id AS id, source AS source_id,
    'https://' || ({_duck_list(SOURCE_HOSTS)})[CAST(substr(source, 4) AS INT) % {len(SOURCE_HOSTS)} + 1]
      || '/story/' || doc_id AS url,
    array_to_string(string_split(text, ' ')[1:12], ' ') AS title,
    text AS raw_text,
    ({_duck_list(K.PRIMARY_CATEGORIES)})[doc_id % 10 + 1] AS category,
    CASE WHEN doc_id % 4 = 0 THEN NULL ELSE ({_duck_list(STATE_NAMES)})[doc_id % 36 + 1] END AS state,
    CASE WHEN doc_id % 5 = 0 THEN 'pune' END AS district,
    CASE WHEN doc_id % 97 = 0 THEN NULL
      ELSE TIMESTAMP '2024-01-28 00:00:00' + to_minutes(CAST((doc_id * 37) % 5760 AS INT)) END AS published_at,
    TIMESTAMP '2024-01-31 00:00:00' + to_seconds(doc_id) AS ingested_at,
    lang
  FROM documents)"""


def one_shard(spark, folder) -> DataFrame:
    """Articles with one category and state, so that near copies can meet."""
    return articles(spark, folder).withColumn("category", F.lit("National")).withColumn("state", F.lit("Delhi"))


ONE_SHARD_SQL = ARTICLES_SQL + """,
one_shard_v AS (SELECT * REPLACE ('National' AS category, 'Delhi' AS state) FROM articles_v)"""


def sources(spark, folder) -> DataFrame:
    number = "cast(substr(source, 4) as int)"
    return (
        table(spark, folder, "documents").select("source").distinct().selectExpr(
            "source as source_id",
            f"element_at({_spark_list(SOURCE_NAMES)}, {number} % {len(SOURCE_NAMES)} + 1) as name",
            f"element_at(array('1', '2', '3'), {number} % 3 + 1) as trust_tier",
            f"element_at({_spark_list(K.PRIMARY_CATEGORIES)}, {number} % 10 + 1) as category",
            f"if({number} % 7 = 0, 'newsapi_dev_only', 'rss') as source_type",
            f"{number} % 5 <> 0 as is_active",
            f"{number} % 4 = 0 as verified_local_source",
        )
    )


SOURCES_SQL = f"""sources_v AS (
  SELECT source AS source_id,
    ({_duck_list(SOURCE_NAMES)})[n % {len(SOURCE_NAMES)} + 1] AS name,
    (['1', '2', '3'])[n % 3 + 1] AS trust_tier,
    ({_duck_list(K.PRIMARY_CATEGORIES)})[n % 10 + 1] AS category,
    CASE WHEN n % 7 = 0 THEN 'newsapi_dev_only' ELSE 'rss' END AS source_type,
    n % 5 <> 0 AS is_active, n % 4 = 0 AS verified_local_source
  FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INT) AS n FROM documents))"""


def cards(spark, folder) -> DataFrame:
    return articles(spark, folder).selectExpr(
        "id as card_id", "id div 2 as cluster_id",
        f"concat(title, '. ', element_at({_spark_list(PHRASES)}, cast(id % {len(PHRASES)} + 1 as int))) as headline",
        "raw_text as summary", "category",
        "if(id % 11 = 0, 'pending_review', 'published') as verified_status",
        "if(id % 9 = 0, 'PROMOTIONAL', 'NEWS') as content_type",
        "if(id % 13 = 0, 'seed', 'live_pipeline') as created_by",
        "state", "district", "published_at", "ingested_at as created_at",
        "cast(id % 10 + 1 as int) as priority_score",
    )


CARDS_SQL = ARTICLES_SQL + f""",
cards_v AS (
  SELECT id AS card_id, id // 2 AS cluster_id,
    title || '. ' || ({_duck_list(PHRASES)})[id % {len(PHRASES)} + 1] AS headline, raw_text AS summary, category,
    CASE WHEN id % 11 = 0 THEN 'pending_review' ELSE 'published' END AS verified_status,
    CASE WHEN id % 9 = 0 THEN 'PROMOTIONAL' ELSE 'NEWS' END AS content_type,
    CASE WHEN id % 13 = 0 THEN 'seed' ELSE 'live_pipeline' END AS created_by,
    state, district, published_at, ingested_at AS created_at,
    CAST(id % 10 + 1 AS INT) AS priority_score
  FROM articles_v)"""


def card_sources(spark, folder) -> DataFrame:
    """Each card cites its own article and the one before it."""
    arts = articles(spark, folder).select("id", "source_id", "url")
    own = arts.selectExpr("id as card_id", "cast(1 as bigint) as ord", "source_id", "url", "id as article_id")
    other = arts.selectExpr(
        "id + 1 as card_id", "cast(2 as bigint) as ord", "source_id", "url", "id as article_id"
    ).join(arts.selectExpr("id as card_id"), "card_id", "left_semi")
    return own.unionByName(other).join(
        sources(spark, folder).select("source_id", "name", "trust_tier"), "source_id"
    ).select("card_id", "ord", "source_id", "name", "url", "trust_tier", "article_id")


CARD_SOURCES_SQL = CARDS_SQL + ",\n" + SOURCES_SQL + """,
card_sources_v AS (
  SELECT x.card_id, x.ord, x.source_id, s.name, x.url, s.trust_tier, x.article_id
  FROM (SELECT id AS card_id, CAST(1 AS BIGINT) AS ord, source_id, url, id AS article_id FROM articles_v
        UNION ALL
        SELECT id + 1, 2, source_id, url, id FROM articles_v
        WHERE id + 1 IN (SELECT id FROM articles_v)) x
  JOIN sources_v s USING (source_id))"""


def runs(spark, folder) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id as run_id", "event_type as provider", "ts as timestamp",
        "cast(floor(value) as bigint) - 2 as credits_used",
        "cast(user_id % 4 as bigint) as articles_ingested", "cast(user_id % 9 as bigint) as sources_polled",
        "if(event_type = 'error', array(props), array()) as errors",
    )


RUNS_SQL = """runs_v AS (
  SELECT event_id AS run_id, event_type AS provider, ts AS timestamp,
    CAST(floor(value) AS BIGINT) - 2 AS credits_used,
    CAST(user_id % 4 AS BIGINT) AS articles_ingested, CAST(user_id % 9 AS BIGINT) AS sources_polled,
    CASE WHEN event_type = 'error' THEN [props] ELSE [] END AS errors
  FROM events)"""


def users(spark, folder) -> DataFrame:
    cats = _spark_list(K.PRIMARY_CATEGORIES)
    return table(spark, folder, "customer").selectExpr(
        "c_custkey as device_id",
        f"element_at({_spark_list(STATE_NAMES)}, c_nationkey + 1) as user_state",
        "if(c_custkey % 3 = 0, 'pune', cast(null as string)) as user_district",
        f"if(c_custkey % 6 = 5, null, concat(slice({cats}, cast(c_custkey % 10 as int) + 1, 10), "
        f"slice({cats}, 1, cast(c_custkey % 10 as int)))) as category_order",
    )


USERS_SQL = f"""users_v AS (
  SELECT c_custkey AS device_id, ({_duck_list(STATE_NAMES)})[c_nationkey + 1] AS user_state,
    CASE WHEN c_custkey % 3 = 0 THEN 'pune' END AS user_district,
    CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE
      list_concat(({_duck_list(K.PRIMARY_CATEGORIES)})[c_custkey % 10 + 1:10],
                  ({_duck_list(K.PRIMARY_CATEGORIES)})[1:c_custkey % 10]) END AS category_order
  FROM customer)"""


def marks(spark, folder) -> DataFrame:
    """Cards seen by readers."""
    cards = max(1, table(spark, folder, "documents").count())
    return table(spark, folder, "events").filter("event_type in ('view', 'click')").selectExpr(
        "user_id as device_id", f"event_id % {cards} as card_id", "event_type as mark"
    ).distinct()


MARKS_SQL = """marks_v AS (
  SELECT DISTINCT user_id AS device_id, event_id % greatest((SELECT count(*) FROM documents), 1) AS card_id, event_type AS mark
  FROM events WHERE event_type IN ('view', 'click'))"""


def requests(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey as request_id", "concat('worker', o_custkey % 50) as worker_id",
        "case o_orderstatus when 'F' then 'succeeded' when 'O' then 'running' else 'pending' end as status",
        "o_orderdate as created_at", "cast(o_orderkey % 4 as int) as attempt_count",
        "cast(o_orderkey % 3 as int) as lease_generation",
    )


REQUESTS_SQL = """requests_v AS (
  SELECT o_orderkey AS request_id, 'worker' || (o_custkey % 50) AS worker_id,
    CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
    o_orderdate AS created_at, CAST(o_orderkey % 4 AS INT) AS attempt_count,
    CAST(o_orderkey % 3 AS INT) AS lease_generation
  FROM orders)"""
