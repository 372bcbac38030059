"""Landed provider payloads and feeds to one article shape."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions.dates import parse_ts
from storyloom.functions.labels import any_contains, canonical_category, wire_of
from storyloom.functions.text import (
    clean_html_text,
    clean_title,
    collapse,
    extract_publisher,
    strip,
    strip_html_basic,
    strip_paywall,
    text_or_empty,
    unescape,
)
from storyloom.functions.urls import normalize_url
from storyloom.sources.pages import page_fields


def _field(name: str) -> Column:
    return strip(text_or_empty(F.col(f"item.{name}")))


def _items(df: DataFrame, payload: str, path: str, fields: list[str]) -> DataFrame:
    """One row per element of an array in a JSON payload column."""
    schema = ", ".join(f"{f}: string" for f in fields)
    doc = F.from_json(F.col(payload), f"struct<{path}: array<struct<{schema}>>>")
    return df.select("*", F.posexplode(doc[path]).alias("item_pos", "item"))


def _shape(df: DataFrame, url: Column, title: Column, body: Column, published: Column, keep) -> DataFrame:
    raw = strip_paywall(body)
    return (
        df.select(
            *keep, "item_pos", url.alias("url"), F.substring(title, 1, 1024).alias("title"), raw.alias("raw_text"),
            published.alias("published_at"),
            wire_of(F.concat_ws(" ", title, body)).alias("wire_attribution"),
        )
        .filter((F.col("url") != "") & (F.col("title") != ""))
    )


def from_newsdata(df: DataFrame, payload="payload", keep=()) -> DataFrame:
    rows = _items(df, payload, "results", ["link", "title", "description", "content", "pubDate"])
    d, c = _field("description"), _field("content")
    body = (
        F.when((d != "") & (c != "") & (d != c), F.concat(d, F.lit("\n\n"), c)).when(c != "", c).otherwise(d)
    )
    return _shape(rows, _field("link"), _field("title"), body, parse_ts(F.col("item.pubDate")), keep)


def from_currents(df: DataFrame, payload="payload", keep=()) -> DataFrame:
    rows = _items(df, payload, "news", ["url", "title", "description", "content", "published"])
    body = strip(F.when(text_or_empty(F.col("item.description")) != "", F.col("item.description"))
                 .otherwise(text_or_empty(F.col("item.content"))))
    return _shape(rows, _field("url"), _field("title"), body, parse_ts(F.col("item.published")), keep)


def from_newsapi(df: DataFrame, payload="payload", keep=()) -> DataFrame:
    """State and district are never known on this path."""
    rows = _items(df, payload, "articles", ["url", "title", "description", "content", "publishedAt"])
    body = strip(F.concat(
        text_or_empty(F.col("item.description")), F.lit("\n\n"), text_or_empty(F.col("item.content"))))
    out = _shape(rows, _field("url"), _field("title"), body, parse_ts(F.col("item.publishedAt")), keep)
    none = F.lit(None).cast("string")
    return out.withColumn("state", none).withColumn("district", none)


def from_serpapi(df: DataFrame, payload="payload", keep=()) -> DataFrame:
    rows = _items(df, payload, "news_results", ["link", "title", "snippet", "date"])
    title, snippet = _field("title"), _field("snippet")
    body = F.when(snippet != "", snippet).otherwise(title)
    return _shape(rows, _field("link"), title, body, parse_ts(F.col("item.date")), keep)


def from_gdelt(df: DataFrame, payload="payload", keep=()) -> DataFrame:
    rows = _items(df, payload, "articles", ["url", "title", "seendate"])
    return _shape(rows, _field("url"), _field("title"), text_or_empty(F.col("item.seendate")),
                  F.lit(None).cast("timestamp"), keep)


_ITEM = r"(?s)<(?:item|entry)(?:\s[^>]*)?>(.*?)</(?:item|entry)>"


def _tag(item: Column, *names: str) -> Column:
    """Text of the first tag present, CDATA markers removed."""
    found = None
    for name in names:
        inner = F.regexp_extract(item, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
        inner = strip(F.regexp_replace(inner, r"^\s*<!\[CDATA\[|\]\]>\s*$", ""))
        value = F.when(inner != "", inner)
        found = value if found is None else F.coalesce(found, value)
    return found


def parse_feeds(feeds: DataFrame, xml="xml", keep=()) -> DataFrame:
    """RSS and Atom documents (one per row) to entries in document order.

    Entries need a link and a title.  Publication and update times are kept
    apart; a missing publication time stays NULL.
    """
    items = feeds.select(*keep, F.posexplode(F.regexp_extract_all(xml, F.lit(_ITEM), F.lit(1))).alias("item_pos", "item"))
    item = F.col("item")
    link = F.coalesce(_tag(item, "link"), F.nullif(F.regexp_extract(item, r"<link[^>]*href=[\"']([^\"']+)", 1), F.lit("")))
    title = unescape(_tag(item, "title"))
    body = strip_html_basic(unescape(F.coalesce(_tag(item, "description", "summary", "content:encoded"), F.lit(""))))
    # address and title are made as a row of their own, which all that follows reads
    heads = items.select(*keep, "item_pos", "item", F.inline(F.array(F.struct(
        normalize_url(unescape(link)).alias("url"), title.alias("title"))))).filter((F.col("url") != "") & (text_or_empty(F.col("title")) != ""))
    title = F.col("title")
    return heads.select(
        *keep, "item_pos", "url", F.substring(title, 1, 1024).alias("title"),
        strip_paywall(body).alias("raw_text"), parse_ts(_tag(item, "pubDate", "published", "dc:date")).alias("published_at"),
        parse_ts(_tag(item, "updated", "lastBuildDate")).alias("source_updated_at"),
        _tag(item, "source").alias("feed_source"),
        wire_of(F.concat_ws(" ", title, body)).alias("wire_attribution"),
    )


def crawl_entries(entries: DataFrame, feed: str, default_source: str, max_items: int = 15, known=None) -> DataFrame:
    """Crawler rules on parsed entries: new links, suffix-free titles, no low-value items, a cap per feed."""
    rows = entries.withColumn("title_raw", F.col("title")).withColumn(
        "title", F.when(F.contains("title", F.lit(" - ")), clean_title("title")).otherwise(F.col("title")))
    rows = rows.filter(~any_contains(F.lower("title"), K.LOW_VALUE_CRAWL))
    if known is not None:
        rows = rows.join(known, "url", "left_anti")
    rows = rows.withColumn("source", extract_publisher("title_raw", default_source, F.col("feed_source"))).withColumn(
        "category", canonical_category("category"))
    first = Window.partitionBy("url").orderBy(feed, "item_pos")
    rows = rows.withColumn("_u", F.row_number().over(first)).filter("_u = 1").drop("_u")
    w = Window.partitionBy(feed).orderBy("item_pos")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_items).drop("_n", "title_raw")


def live_entries(entries: DataFrame, as_of, feed: str, default_source: str, max_items: int = 20) -> DataFrame:
    """Live-feed rules: the first entries per feed, recent, one per address and headline key."""
    from storyloom.functions.text import headline_key
    from storyloom.operators.filters import drop_low_value, within_hours

    w = Window.partitionBy(feed).orderBy("item_pos")
    rows = entries.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_items).drop("_n")
    rows = rows.withColumn("source", extract_publisher("title", default_source, F.col("feed_source")))
    rows = rows.withColumn("title", strip(clean_title("title"))).withColumn("headline_key", headline_key("title"))
    rows = within_hours(drop_low_value(rows, phrases=K.LOW_VALUE_LIVE), as_of)
    for key in ("url", "headline_key"):
        u = Window.partitionBy(key).orderBy(feed, "item_pos")
        rows = rows.withColumn("_n", F.row_number().over(u)).filter("_n = 1").drop("_n")
    return rows


# --- pages ---------------------------------------------------------------------

def extract_meta(pages: DataFrame, html="html", keep=()) -> DataFrame:
    """Title, summary, body paragraphs, author and date of an article page.

    content has the text nodes directly inside paragraphs of content nodes, however deep these are; markup inside is skipped.
    """
    read = pages.select(*keep, page_fields(html).alias("_page"))
    return read.select(*keep, *[F.col(f"_page.{c}").alias(c) for c in ("title", "summary", "content", "author")],
                       parse_ts(F.nullif(F.col("_page.published"), F.lit(""))).alias("published_at"))


_LIST_ITEM = r"(?is)<li[^>]*>\s*<a[^>]*>(.*?)</a>(?:(?:&nbsp;|\s)*<font[^>]*>(.*?)</font>)?"


def coverage_items(html) -> Column:
    """Array of (headline, publisher) of the linked items of a list, in order; those without a headline are left out."""
    heads = F.regexp_extract_all(html, F.lit(_LIST_ITEM), F.lit(1))
    pubs = F.regexp_extract_all(html, F.lit(_LIST_ITEM), F.lit(2))
    pairs = F.zip_with(heads, pubs, lambda h, p: F.struct(clean_html_text(h).alias("headline"), clean_html_text(p).alias("publisher")))
    return F.filter(F.coalesce(pairs, F.array().cast("array<struct<headline:string,publisher:string>>")), lambda i: i["headline"] != "")


def explode_coverage(df: DataFrame, html="html", keep=()) -> DataFrame:
    """(headline, publisher) rows of a list of linked items."""
    heads = F.regexp_extract_all(html, F.lit(_LIST_ITEM), F.lit(1))
    pubs = F.regexp_extract_all(html, F.lit(_LIST_ITEM), F.lit(2))
    pairs = F.zip_with(heads, pubs, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
    return df.select(*keep, F.posexplode(pairs).alias("item_pos", "x")).select(
        *keep, "item_pos", clean_html_text(F.col("x.h")).alias("headline"),
        clean_html_text(F.col("x.p")).alias("publisher"),
    ).filter("headline <> ''")


def coverage_summary(rows: DataFrame, key: str, headline: str = "title") -> DataFrame:
    """Text built from the second to fourth listed items of a coverage list."""
    used = rows.filter(F.col("item_pos").between(1, 3)).filter(F.lower("headline") != F.lower(headline))
    part = F.when(F.col("publisher") != "", F.concat("publisher", F.lit(" reports: "), "headline")).otherwise(
        F.col("headline"))
    return used.groupBy(key).agg(F.concat(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("item_pos", part.alias("p")))), lambda e: e["p"]), ". "),
        F.lit(".")).alias("summary"))
