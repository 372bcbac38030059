"""Column functions over whole tables."""

from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions import dates, facts, keywords, labels, text, urls, vectors
from storyloom.plans import fixtures as V
from storyloom.plans import sqltext as Q
from storyloom.plans.registry import query


def _docs(spark, folder):
    return V.table(spark, folder, "documents")


def _pages(spark, folder):
    return V.table(spark, folder, "pages")


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def joined(c):
    return F.array_join(F.array_sort(c), " ")


_PARTS = r"""parts AS (
  SELECT page_id, url, regexp_extract(url, '^([^#]*)', 1) AS bare FROM pages),
split AS (
  SELECT page_id, url,
    lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) AS scheme,
    lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?]*)', 1)) AS host,
    regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*([^?]*)', 1) AS path,
    list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '') AS pairs
  FROM parts)"""

NORMALIZE_SQL = "WITH " + _PARTS + f""",
kept AS (
  SELECT *, list_sort(list_filter(pairs, lambda p: NOT list_contains({Q.lits(K.TRACKING_PARAMS)},
    lower(split_part(p, '=', 1))))) AS q FROM split)
SELECT page_id, scheme || '://' || host
    || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END
    || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS normalized_url
FROM kept"""


@query("normalize_url", NORMALIZE_SQL)
def normalize_url(spark, folder):
    return _pages(spark, folder).select("page_id", urls.normalize_url("url").alias("normalized_url"))


@query("drop_utm", r"""
WITH p AS (SELECT page_id, regexp_replace(trim(url), '/$', '') AS u FROM pages),
s AS (SELECT page_id, regexp_extract(u, '^([^?#]*)', 1) AS head,
        list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'),
                    lambda x: x <> '' AND NOT starts_with(x, 'utm_')) AS q,
        regexp_extract(u, '(#.*)$', 1) AS frag FROM p)
SELECT page_id, head || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END
  || CASE WHEN frag = '#' THEN '' ELSE frag END AS url FROM s""")
def drop_utm(spark, folder):
    return _pages(spark, folder).select("page_id", urls.drop_utm("url").alias("url"))


@query("strip_html_basic", f"""
SELECT page_id, {Q.strip("replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' ')")} AS body FROM pages""")
def strip_html_basic(spark, folder):
    return _pages(spark, folder).select("page_id", text.strip_html_basic("html").alias("body"))


# Texts with references, and what they stand for.
_PLANTED_REFERENCES = [
    ("It&#x27;s", "It's"), ("It&#39;s", "It's"), ("r&iacute;o &Ntilde;and&uacute;", "río Ñandú"), ("a &lt;b&gt; c", "a <b> c"),
    ("fish &amp; chips", "fish & chips"), ("&amp;lt;", "&lt;"), ("&#128512;&#x1F600;", "😀😀"), ("&#146;quoted&#8217;", "’quoted’"),
    ("&nosuchname; & alone &", "&nosuchname; & alone &"), ("&#1114112;", "\ufffd"), ("5 &times; 3 &ne; 16 &rarr; x", "5 × 3 ≠ 16 → x"),
    ("&hearts;&#X2665;", "♥♥"), ("plain", "plain"),
]


@query("character_references", "SELECT doc_id, text || ' ' || (" + Q.lits([b for _, b in _PLANTED_REFERENCES])
       + f")[doc_id % {len(_PLANTED_REFERENCES)} + 1] AS body FROM (SELECT doc_id, replace(text, '&', '+') AS text FROM documents)")
def character_references(spark, folder):
    """Planted references behind every text."""
    planted = F.element_at(F.array(*[F.lit(a) for a, _ in _PLANTED_REFERENCES]), (F.col("doc_id") % len(_PLANTED_REFERENCES) + 1).cast("int"))
    rows = V.table(spark, folder, "documents").select("doc_id", F.concat_ws(" ", F.replace("text", F.lit("&"), F.lit("+")), planted).alias("t"))
    return rows.select("doc_id", text.unescape("t").alias("body"))


_TAGLESS = "regexp_replace(html, '<[^>]+>', ' ', 'g')"


@query("clean_text", f"WITH {Q.REFERENCES} SELECT page_id, "
       + Q.collapse(Q.replace_all(Q.decode("coalesce(" + _TAGLESS + ", '')"), text.CRAWL_PUNCTUATION)) + " AS body FROM pages, refs")
def clean_text(spark, folder):
    return _pages(spark, folder).select("page_id", text.clean_text("html").alias("body"))


_LIVE = Q.collapse(Q.replace_all(
    "replace(regexp_replace(" + Q.decode("html") + ", '<[^>]+>', ' ', 'g'), '&nbsp;', ' ')", text.LIVE_PUNCTUATION))


@query("clean_html_text", f"WITH {Q.REFERENCES} SELECT page_id, {_LIVE} AS body FROM pages, refs")
def clean_html_text(spark, folder):
    return _pages(spark, folder).select("page_id", text.clean_html_text("html").alias("body"))


@query("clean_chat_text", f"WITH {Q.REFERENCES} SELECT page_id, " + Q.collapse(Q.decode(_TAGLESS)) + " AS body FROM pages, refs")
def clean_chat_text(spark, folder):
    return _pages(spark, folder).select("page_id", text.clean_chat_text("html").alias("body"))


def _paywall_sql(x):
    for p in K.PAYWALL_PATTERNS:
        x = f"regexp_replace({x}, {Q.lit('(?is)' + p)}, '', 'g')"
    return Q.strip(x)


# every third text gets a paywall line, so that the cut is exercised
@query("strip_paywall", "SELECT doc_id, " + _paywall_sql(
    "CASE WHEN doc_id % 3 = 0 THEN text || ' Subscribe  now to read the rest' ELSE text END") + " AS body FROM documents")
def strip_paywall(spark, folder):
    body = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" Subscribe  now to read the rest"))).otherwise(
        F.col("text"))
    return _docs(spark, folder).select("doc_id", text.strip_paywall(body).alias("body"))


@query("norm", f"SELECT doc_id, lower({Q.collapse('text')}) AS body FROM documents")
def norm(spark, folder):
    return _docs(spark, folder).select("doc_id", text.norm("text").alias("body"))


_HEAD_SQL = "title || ' - ' || source_id"


@query("clean_title", "WITH " + V.ARTICLES_SQL
       + rf" SELECT id, regexp_replace({_HEAD_SQL}, '\s+-\s+[^-]+$', '') AS title FROM articles_v")
def clean_title(spark, folder):
    head = F.concat("title", F.lit(" - "), "source_id")
    return V.articles(spark, folder).select("id", text.clean_title(head).alias("title"))


@query("extract_publisher", "WITH " + V.ARTICLES_SQL + """
SELECT id, CASE WHEN contains(t, ' - ') AND length(tail) < 35 THEN trim(tail) ELSE 'Desk' END AS publisher
FROM (SELECT id, t, regexp_extract(t, '^(?s:.*) - (.*)$', 1) AS tail FROM (
  SELECT id, CASE WHEN id % 2 = 0 THEN title || ' - ' || source_id ELSE title END AS t FROM articles_v))""")
def extract_publisher(spark, folder):
    head = F.when(F.col("id") % 2 == 0, F.concat("title", F.lit(" - "), "source_id")).otherwise(F.col("title"))
    return V.articles(spark, folder).select("id", text.extract_publisher(head, F.lit("Desk")).alias("publisher"))


@query("headline_key", "WITH " + V.ARTICLES_SQL
       + " SELECT id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS headline_key FROM articles_v")
def headline_key(spark, folder):
    return V.articles(spark, folder).select("id", text.headline_key("title").alias("headline_key"))


@query("keywords", f"""
SELECT doc_id, array_to_string(list_sort({Q.keywords('text', K.WORKER_STOPWORDS)}), ' ') AS worker_keywords,
  array_to_string(list_sort({Q.keywords('text', K.CRAWL_STOPWORDS)}), ' ') AS crawl_keywords FROM documents""")
def keyword_sets(spark, folder):
    return _docs(spark, folder).select(
        "doc_id", joined(keywords.keywords("text")).alias("worker_keywords"),
        joined(keywords.keywords("text", K.CRAWL_STOPWORDS)).alias("crawl_keywords"))


_PAIR_SQL = "WITH " + V.ARTICLES_SQL + f""",
k AS (SELECT id, {Q.keywords('title', K.WORKER_STOPWORDS)} AS words FROM articles_v)
SELECT a.id, CAST(len(list_intersect(a.words, b.words)) AS BIGINT) AS shared,
  round(CASE WHEN len(a.words) = 0 OR len(b.words) = 0 THEN 0.0
    ELSE len(list_intersect(a.words, b.words))::DOUBLE / len(list_distinct(list_concat(a.words, b.words))) END, 6)
    AS jaccard
FROM k a JOIN k b ON b.id = a.id - 1"""


def _neighbours(spark, folder):
    arts = V.articles(spark, folder)
    a = arts.select("id", keywords.keywords("title").alias("words"))
    b = arts.select((F.col("id") + 1).alias("id"), keywords.keywords("title").alias("other"))
    return a.join(b, "id")


@query("keyword_overlap", _PAIR_SQL)
def keyword_overlap(spark, folder):
    return _neighbours(spark, folder).select(
        "id", keywords.keyword_overlap(F.col("words"), F.col("other")).cast("bigint").alias("shared"),
        F.round(keywords.keyword_jaccard(F.col("words"), F.col("other")), 6).alias("jaccard"))


_PLANTED = " || ' ' || ".join(["text", "CASE WHEN doc_id % 7 = 0 THEN 'Cabinet resigns; election and market crash' "
                               "WHEN doc_id % 5 = 0 THEN 'Emergency: flood kills, court probe' ELSE '' END"])


@query("impact_hits", f"""
SELECT doc_id, CAST({Q.hits('t', K.WORKER_IMPACT_TERMS)} AS BIGINT) AS worker_hits,
  CAST({Q.hits('t', K.CRAWL_IMPACT_TERMS)} AS BIGINT) AS crawl_hits
FROM (SELECT doc_id, {Q.ascii_words(f"lower({_PLANTED})")} AS t FROM documents)""")
def impact_hits(spark, folder):
    t = F.concat("text", F.lit(" "), F.when(F.col("doc_id") % 7 == 0, "Cabinet resigns; election and market crash")
                 .when(F.col("doc_id") % 5 == 0, "Emergency: flood kills, court probe").otherwise(""))
    return _docs(spark, folder).select(
        "doc_id", keywords.impact_hits(t).cast("bigint").alias("worker_hits"),
        keywords.impact_hits(t, K.CRAWL_IMPACT_TERMS).cast("bigint").alias("crawl_hits"))


@query("word_count", f"SELECT doc_id, {Q.word_count('text')} AS words FROM documents")
def word_count(spark, folder):
    return _docs(spark, folder).select("doc_id", text.word_count("text").alias("words"))


@query("sentence_count", f"SELECT doc_id, {Q.sentence_count('text')} AS sentences FROM documents")
def sentence_count(spark, folder):
    return _docs(spark, folder).select("doc_id", text.sentence_count("text").alias("sentences"))


@query("readability_grade", f"SELECT doc_id, {Q.fk_grade('text')} AS grade FROM documents")
def readability_grade(spark, folder):
    return _docs(spark, folder).select("doc_id", text.fk_grade("text").alias("grade"))


_SENS = "text || CASE WHEN doc_id % 6 = 0 THEN ' Riot after election' WHEN doc_id % 9 = 0 THEN ' a shocking fire' ELSE '' END"


def _sens():
    return F.concat("text", F.when(F.col("doc_id") % 6 == 0, " Riot after election")
                    .when(F.col("doc_id") % 9 == 0, " a shocking fire").otherwise(""))


@query("token_hits", f"""
SELECT doc_id, array_to_string(list_sort(list_intersect({Q.lits(K.BANNED_OPINION)}, tok)), ',') AS banned,
  list_has_any(tok, {Q.lits(K.SENSITIVITY)}) AS sensitive,
  list_has_any(tok, {Q.lits(K.SENSITIVITY + K.VISUAL_SENSITIVE)}) AS visual_sensitive
FROM (SELECT doc_id, {Q.tokens(_SENS)} AS tok FROM documents)""")
def token_hits(spark, folder):
    return _docs(spark, folder).select(
        "doc_id", F.array_join(text.token_hits(_sens(), K.BANNED_OPINION), ",").alias("banned"),
        text.has_any_token(_sens(), K.SENSITIVITY).alias("sensitive"),
        labels.is_sensitive_visual(_sens()).alias("visual_sensitive"))


_PARA_TEXT = "CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END"


@query("format_paragraphs", f"""
WITH t AS (SELECT doc_id, {_PARA_TEXT} AS raw FROM documents),
c AS (SELECT doc_id, raw, {Q.clean_text('raw')} AS cleaned,
  list_filter(list_transform(string_split(raw, chr(10) || chr(10)), lambda p: {Q.clean_text('p')}), lambda p: p <> '') AS given
  FROM t),
s AS (SELECT *, {Q.sentences('cleaned')} AS s FROM c)
SELECT doc_id, CASE WHEN cleaned = '' THEN ''
  WHEN contains(raw, chr(10) || chr(10)) AND len(given) >= 2 THEN array_to_string(given, chr(10) || chr(10))
  WHEN len(s) <= 2 THEN cleaned
  WHEN len(s) <= 4 THEN array_to_string(s[1:len(s) // 2], ' ') || chr(10) || chr(10) || array_to_string(s[len(s) // 2 + 1:], ' ')
  ELSE array_to_string(s[1:2], ' ') || chr(10) || chr(10) || array_to_string(s[3:4], ' ') || chr(10) || chr(10)
    || array_to_string(s[5:], ' ') END AS body FROM s""")
def format_paragraphs(spark, folder):
    raw = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text"))
    return _docs(spark, folder).select("doc_id", text.format_paragraphs(raw).alias("body"))


@query("first_words", rf"""
WITH t AS (SELECT doc_id, text, regexp_split_to_array({Q.strip('text')}, '\s+') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) <= 60 THEN text ELSE array_to_string(w[1:60], ' ') || '…' END AS opening,
  CASE WHEN length(text) > 300 THEN regexp_replace(substring(text, 1, 297), '\s+$', '') || '...' ELSE text END AS teaser
FROM t""")
def first_words(spark, folder):
    return _docs(spark, folder).select(
        "doc_id", text.first_words("text", 60).alias("opening"), text.first_chars("text", 300).alias("teaser"))


_H = "headline"
# letters whose capital form is several letters (ß, SS), where the other engine's upper gives one
_LONG_CAPITALS = ", ".join(f"{Q.lit(c)}: {Q.lit(c.upper())}" for c in map(chr, range(128, 0x10000)) if len(c.upper()) > 1)
_PUB = K.SUMMARY_PUBLISHERS


@query("clean_summary", "WITH " + V.ARTICLES_SQL + rf""",
t AS (SELECT id, {Q.strip('title')} AS h,
  {Q.strip("CASE id % 4 WHEN 0 THEN title || ' - ' || raw_text WHEN 1 THEN 'Reuters: ' || raw_text WHEN 2 THEN replace(title, ' ', ', ') || ' ' || raw_text ELSE raw_text END")} AS s
  FROM articles_v),
w AS (SELECT *, regexp_split_to_array(h, '\s+') AS hw, regexp_split_to_array(s, '\s+') AS sw FROM t),
a AS (SELECT id, CASE WHEN starts_with(lower(s), lower(h)) THEN {Q.strip('substring(s, length(h) + 1)')}
    WHEN len(hw) >= 3 AND len(sw) > len(hw)
      AND list_transform(hw, lambda x: {Q.bare('x')}) = list_transform(sw[1:len(hw)], lambda x: {Q.bare('x')})
      THEN {Q.strip("array_to_string(sw[len(hw) + 1:], ' ')")} ELSE s END AS o FROM w),
b AS (SELECT id, {Q.strip("regexp_replace(o, '^[.:" + chr(92) + "-–—," + chr(92) + "s]+', '')")} AS o FROM a),
c AS (SELECT id, {Q.strip("regexp_replace(o, '(?i)^(?:" + _PUB + ")" + chr(92) + "s*[:" + chr(92) + "-–—.]*" + chr(92) + "s*', '')")} AS o FROM b),
d AS (SELECT id, o, {Q.sentences('o')} AS p FROM c),
e AS (SELECT id, CASE WHEN len(p) >= 2 AND {Q.bare('p[1]')} <> '' AND {Q.bare('p[1]')} = {Q.bare('p[2]')}
  THEN {Q.strip("array_to_string(p[2:], ' ')")} ELSE o END AS o FROM d)
SELECT id, CASE WHEN length(o) < 15 THEN {Q.lit(K.SHORT_SUMMARY_TEXT)}
  ELSE coalesce(MAP {{{_LONG_CAPITALS}}}[substring(o, 1, 1)], upper(substring(o, 1, 1))) || substring(o, 2) END AS summary FROM e""")
def clean_summary(spark, folder):
    s = (F.when(F.col("id") % 4 == 0, F.concat("title", F.lit(" - "), "raw_text"))
         .when(F.col("id") % 4 == 1, F.concat(F.lit("Reuters: "), "raw_text"))
         .when(F.col("id") % 4 == 2, F.concat(F.replace("title", F.lit(" "), F.lit(", ")), F.lit(" "), "raw_text")).otherwise(F.col("raw_text")))
    return V.articles(spark, folder).select("id", text.clean_summary(F.col("title"), s).alias("summary"))


_PLAIN = "CASE WHEN len(w) <= 60 THEN text ELSE array_to_string(w[1:60], ' ') || '…' END"
for _p, _r in K.PLAIN_REWRITES:
    _PLAIN = f"regexp_replace({_PLAIN}, {Q.lit('(?i)' + _p)}, {Q.lit(_r)}, 'g')"


@query("simplify", rf"""
WITH d AS (SELECT doc_id, 'Operational benchmarks hold. ' || text AS text FROM documents),
t AS (SELECT doc_id, text, regexp_split_to_array({Q.strip('text')}, '\s+') AS w FROM d)
SELECT doc_id, {_PLAIN} AS plain FROM t""")
def simplify(spark, folder):
    t = F.concat(F.lit("Operational benchmarks hold. "), "text")
    return _docs(spark, folder).select("doc_id", text.simplify(t).alias("plain"))


@query("lead_sentences", "WITH " + V.ARTICLES_SQL + rf""",
t AS (SELECT id, title, source_id, list_filter(list_transform({Q.sentences(Q.collapse('raw_text'))}, lambda s: trim(s)),
  lambda s: length(s) > 20 AND NOT starts_with(lower(s), 'sign up') AND NOT starts_with(lower(s), 'subscribe')) AS g
  FROM articles_v),
u AS (SELECT *, array_to_string(g, ' ') AS few FROM t),
v AS (SELECT id, CASE WHEN len(g) >= 3 THEN array_to_string(g[1:3], ' ')
  WHEN len(g) >= 1 AND len(string_split(few, ' ')) < 40 THEN title || '. ' || few
    || ' Further details and verified reports are being monitored by ' || source_id || '.'
  WHEN len(g) >= 1 THEN few
  ELSE title || '. Developments are actively being monitored and verified across international correspondents and official sources.'
  END AS o FROM u),
x AS (SELECT id, o, regexp_split_to_array({Q.strip('o')}, '\s+') AS w FROM v)
SELECT id, CASE WHEN len(w) <= 85 THEN o WHEN ends_with(w[85], '.') THEN array_to_string(w[1:85], ' ')
  ELSE array_to_string(w[1:85], ' ') || '...' END AS summary FROM x""")
def lead_sentences(spark, folder):
    return V.articles(spark, folder).select("id", text.lead_sentences(
        F.col("title"), F.col("raw_text"), F.col("source_id")).alias("summary"))


@query("parse_ts", f"""
WITH t AS (SELECT event_id, date_trunc('second', ts) AS s FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 3 THEN {Q.stamp("s - INTERVAL '5 hours 30 minutes'")}
  ELSE {Q.stamp('s')} END AS parsed FROM t""")
def parse_ts(spark, folder):
    """Event times written as feed dates of several kinds and read back."""
    ts = F.col("ts")
    raw = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Tue, "), F.date_format(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(F.col("event_id") % 5 == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(F.col("event_id") % 5 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(F.col("event_id") % 5 == 3, F.concat(F.lit("Tue, "), F.date_format(ts, "d MMM yyyy HH:mm:ss"), F.lit(" +0530")))
        .otherwise(F.lit("yesterday"))
    )
    return V.table(spark, folder, "events").select("event_id", stamp(dates.parse_ts(raw)).alias("parsed"))


@query("age_label", "WITH " + V.ARTICLES_SQL + f""",
a AS (SELECT id, published_at AS ts, date_diff('second', published_at, TIMESTAMP '{V.AS_OF}') AS s FROM articles_v)
SELECT id, CASE WHEN ts IS NULL THEN 'Recent Dispatch' WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN (s // 60) || 'm ago'
  WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 172800 THEN 'Yesterday' WHEN s < 604800 THEN (s // 86400) || 'd ago'
  ELSE strftime(ts, '%b %-d') END AS label FROM a""")
def age_label(spark, folder):
    return V.articles(spark, folder).select("id", dates.age_label("published_at", V.AS_OF).alias("label"))


@query("extract_district", "WITH " + V.ARTICLES_SQL + rf"""
SELECT id, CASE WHEN coalesce(trim(lower(district)), '') <> '' THEN trim(lower(district))
  ELSE regexp_extract({Q.ascii_words("lower(title || ' district nashik ' || raw_text)")}, '\bdistrict\s+([a-z]+)\b', 1) END AS district
FROM articles_v""")
def extract_district(spark, folder):
    return V.articles(spark, folder).select("id", labels.extract_district(
        F.col("district"), F.concat("title", F.lit(" district nashik")), F.col("raw_text")).alias("district"))


@query("canonical_category", f"""
SELECT p_partkey, {Q.canonical_category("(" + Q.lits(['tech', ' World News ', 'ECONOMY', 'india', '', 'Motoring', 'climate']) + ")[p_partkey % 7 + 1]")} AS category FROM part""")
def canonical_category(spark, folder):
    raw = F.get(F.array(*[F.lit(x) for x in ["tech", " World News ", "ECONOMY", "india", "", "Motoring", "climate"]]),
                (F.col("p_partkey") % 7).cast("int"))
    return V.table(spark, folder, "part").select("p_partkey", labels.canonical_category(raw).alias("category"))


def _title_case(t, c):
    arms = []
    for label, terms in K.TITLE_CATEGORY_TERMS:
        value = "CASE WHEN contains(t, 'nepal') THEN 'national' ELSE 'state' END" if label == "disaster" else Q.lit(label)
        arms.append(f"WHEN {Q.contains_any('t', terms)} THEN {value}")
    return (f"CASE {' '.join(arms)} WHEN c IN {Q.in_list(K.TITLE_CATEGORY_KEPT)} THEN c ELSE 'national' END")


@query("category_from_title", "WITH " + V.ARTICLES_SQL + f"""
SELECT id, {_title_case('t', 'c')} AS category FROM (
  SELECT id, lower(title || CASE id % 9 WHEN 0 THEN ' Flood in Nepal' WHEN 1 THEN ' Bank trade' WHEN 2 THEN ' cyclone'
    ELSE '' END) AS t, lower(category) AS c FROM articles_v)""")
def category_from_title(spark, folder):
    t = F.concat("title", F.when(F.col("id") % 9 == 0, " Flood in Nepal").when(F.col("id") % 9 == 1, " Bank trade")
                 .when(F.col("id") % 9 == 2, " cyclone").otherwise(""))
    return V.articles(spark, folder).select("id", labels.category_from_title(t, F.col("category")).alias("category"))


@query("expand_category", "WITH " + V.ARTICLES_SQL + f"""
SELECT id, array_to_string(list_sort(list_distinct(list_concat([c], coalesce({Q.category_map('c', K.FEED_SYNONYMS)}, [c])))), ' ') AS feed_synonyms,
  array_to_string(list_sort(list_distinct(list_concat([c], coalesce({Q.category_map('c', K.CLIENT_SYNONYMS)}, [c])))), ' ') AS client_synonyms
FROM (SELECT id, lower(category) AS c FROM articles_v)""")
def expand_category(spark, folder):
    return V.articles(spark, folder).select(
        "id", joined(labels.expand_category(F.col("category"))).alias("feed_synonyms"),
        joined(labels.expand_category(F.col("category"), K.CLIENT_SYNONYMS)).alias("client_synonyms"))


_WIRE_TEXT = "title || CASE id % 5 WHEN 0 THEN ' (PTI) ' WHEN 1 THEN ' reuters ' ELSE ' ' END || raw_text"


@query("wire_of", "WITH " + V.ARTICLES_SQL + rf"""
SELECT id, nullif(upper(regexp_extract({Q.ascii_words(f"substring({_WIRE_TEXT}, 1, 200)")}, '(?i)\b({K.WIRE_AGENCIES})\b', 1)), '') AS wire,
  {Q.contains_any(f"lower({_WIRE_TEXT})", K.WIRE_MARKERS)} AS has_marker FROM articles_v""")
def wire_of(spark, folder):
    t = F.concat("title", F.when(F.col("id") % 5 == 0, " (PTI) ").when(F.col("id") % 5 == 1, " reuters ").otherwise(" "), "raw_text")
    return V.articles(spark, folder).select("id", labels.wire_of(t).alias("wire"), labels.has_wire_marker(t).alias("has_marker"))


@query("publisher_entity", "WITH " + V.CARD_SOURCES_SQL
       + f" SELECT card_id, ord, {Q.publisher_entity('name', 'url')} AS entity FROM card_sources_v")
def publisher_entity(spark, folder):
    return V.card_sources(spark, folder).select(
        "card_id", "ord", labels.publisher_entity(F.col("name"), F.col("url")).alias("entity"))


@query("scoring_publisher", "WITH " + V.CARD_SOURCES_SQL + f"""
SELECT card_id, ord, {Q.scoring_publisher('name', 'url', 'trust_tier')} AS publisher,
  CAST({Q.scoring_tier('name')} AS BIGINT) AS tier FROM card_sources_v""")
def scoring_publisher(spark, folder):
    return V.card_sources(spark, folder).select(
        "card_id", "ord", labels.scoring_publisher(F.col("name"), F.col("url"), F.col("trust_tier")).alias("publisher"),
        labels.scoring_tier(F.col("name")).cast("bigint").alias("tier"))


PROVENANCE = """CASE WHEN trust_tier = '3' OR contains(lower(name), 'unresolved') THEN 'unresolved'
    WHEN contains(lower(url), 'google') THEN 'name_only_match'
    WHEN contains(lower(name), 'bbc') AND (contains(lower(url), 'bbc.co.uk') OR contains(lower(url), 'bbci.co.uk')) THEN 'verified_identity'
    WHEN contains(lower(name), 'the new york times') AND contains(lower(url), 'nytimes.com') THEN 'verified_identity'
    WHEN (contains(lower(url), 'bbc.co.uk') OR contains(lower(url), 'nytimes.com'))
      AND NOT (contains(lower(name), 'bbc') OR contains(lower(name), 'new york times')) THEN 'domain_conflict'
    ELSE 'name_only_match' END"""


@query("provenance", "WITH " + V.CARD_SOURCES_SQL + f"""
SELECT card_id, ord, CASE WHEN contains(lower(url), 'google') THEN 'aggregator' ELSE 'direct' END AS url_type,
  {PROVENANCE} AS provenance FROM card_sources_v""")
def provenance(spark, folder):
    return V.card_sources(spark, folder).select(
        "card_id", "ord", labels.url_type(F.col("url")).alias("url_type"),
        labels.provenance(F.col("source_id"), F.col("name"), F.col("url"), F.col("trust_tier")).alias("provenance"))


_FACT_TEXT = "(doc_id % 40) || ' hires and ' || (doc_id % 7) || '.5 percent. ' || text"
_FACT = r"(\d+(?:\.\d+)?)\s+([a-zA-Z]+)"


@query("numeric_facts", f"""
WITH t AS (SELECT doc_id, lower({_FACT_TEXT}) AS low FROM documents),
f AS (SELECT doc_id, unnest(regexp_extract_all(low, '{_FACT}', 2)) AS label,
  unnest(regexp_extract_all(low, '{_FACT}', 1)) AS v FROM t)
SELECT doc_id, label, round(CAST(v AS DOUBLE), 6) AS value FROM f""")
def numeric_facts(spark, folder):
    t = F.concat((F.col("doc_id") % 40).cast("string"), F.lit(" hires and "), (F.col("doc_id") % 7).cast("string"),
                 F.lit(".5 percent. "), "text")
    return _docs(spark, folder).select("doc_id", F.explode(facts.numeric_facts(t)).alias("f")).select(
        "doc_id", "f.label", F.round("f.value", 6).alias("value"))


@query("rel_diff", """
SELECT l_orderkey, l_linenumber, l_partkey, round(abs(l_quantity - l_extendedprice) /
  greatest(abs(l_quantity), abs(l_extendedprice), 1e-9), 6) AS diff FROM lineitem""")
def rel_diff(spark, folder):
    return V.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round(facts.rel_diff(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("diff"))


@query("casualties", """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 1000 + doc_id WHEN 1 THEN 5 WHEN 2 THEN 40 + doc_id % 3 WHEN 3 THEN NULL
  WHEN 4 THEN doc_id % 90 + 10 END::BIGINT AS deaths FROM documents""")
def casualties(spark, folder):
    """Death counts planted in whole texts: thousands, words, tolls, money."""
    d = F.col("doc_id")
    planted = (
        F.when(d % 6 == 0, F.concat(F.lit(" Floods claim "), F.format_number(d + 1000, 0), F.lit(" lives.")))
        .when(d % 6 == 1, F.lit(" Five killed in crash."))
        .when(d % 6 == 2, F.concat(F.lit(" The death toll reaches "), (40 + d % 3).cast("string"), F.lit(" today.")))
        .when(d % 6 == 3, F.lit(" Damage estimated at $1,385 million, 1,385 homes and 20 people affected."))
        .when(d % 6 == 4, F.concat(F.lit(" At least "), (d % 90 + 10).cast("string"), F.lit(" people have died.")))
        .otherwise("")
    )
    return _docs(spark, folder).select(
        "doc_id", facts.casualties(F.concat("text", planted)).cast("bigint").alias("deaths"))


def _visual_case():
    arms = " ".join(f"WHEN {Q.contains_any('h', terms)} THEN {Q.lit(q)}" for terms, q in K.VISUAL_TOPICS)
    cats = " ".join(f"WHEN {Q.lit(k)} THEN {Q.lit(v)}" for k, v in K.VISUAL_CATEGORIES.items())
    sens = f"list_has_any({Q.tokens('h || chr(32) || s')}, {Q.lits(K.SENSITIVITY + K.VISUAL_SENSITIVE)})"
    return f"CASE WHEN {sens} THEN NULL {arms} ELSE CASE lower(c) {cats} ELSE {Q.lit(K.VISUAL_DEFAULT)} END END"


@query("visual_query", "WITH " + V.CARDS_SQL + f"""
SELECT card_id, {_visual_case()} AS photo_query FROM (
  SELECT card_id, lower(headline || CASE card_id % 8 WHEN 0 THEN ' airport' WHEN 1 THEN ' funeral' WHEN 2 THEN ' moon' ELSE '' END) AS h,
    summary AS s, category AS c FROM cards_v)""")
def visual_query(spark, folder):
    h = F.concat("headline", F.when(F.col("card_id") % 8 == 0, " airport").when(F.col("card_id") % 8 == 1, " funeral")
                 .when(F.col("card_id") % 8 == 2, " moon").otherwise(""))
    return V.cards(spark, folder).select("card_id", labels.visual_query(
        h, F.col("summary"), F.col("category")).alias("photo_query"))


@query("vector_cosine", """
SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
  sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1""")
def vector_cosine(spark, folder):
    v = V.table(spark, folder, "embeddings")
    other = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(other, "vec_id").select(
        "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("json_columns", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  '{"k":' || json_extract_string(props, '$.k') || '}' AS again FROM events""")
def json_columns(spark, folder):
    doc = F.from_json("props", "struct<k: bigint>")
    return V.table(spark, folder, "events").select("event_id", doc["k"].alias("k"), F.to_json(doc).alias("again"))


@query("parse_dimensions", """
SELECT event_id, least(20.0, greatest(0.0, value)) AS human, least(10.0, k / 4.0) AS policy,
  CASE WHEN event_id % 2 = 0 THEN least(1.0, value) ELSE 0.9 END AS policy_confidence, 0.0 AS security
FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def parse_dimensions(spark, folder):
    """Events as supplied impact scores: one plain number, one object, six missing."""
    k = F.get_json_object("props", "$.k").cast("double")
    part = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct((k / 4).alias("score"), F.col("value").alias("confidence")))
                  ).otherwise(F.to_json(F.struct((k / 4).alias("score"))))
    doc = F.concat(F.lit('{"human_impact":'), F.col("value").cast("string"), F.lit(',"policy_impact":'), part, F.lit("}"))
    d = facts.parse_dimensions(doc)
    return V.table(spark, folder, "events").select(
        "event_id", d["human"]["score"].alias("human"), d["policy"]["score"].alias("policy"),
        d["policy"]["confidence"].alias("policy_confidence"), d["security"]["score"].alias("security"))
