"""Literal text, URL and date cases."""

import html

import pytest
from pyspark.sql import functions as F

from storyloom.functions import dates, labels, text, urls


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,clean", [
    ("https://WWW.Example.com/Path/?utm_source=rss&b=2&a=1#top", "https://www.example.com/Path?a=1&b=2"),
    ("https://example.com/", "https://example.com/"), ("  https://example.com/a/?fbclid=x ", "https://example.com/a"),
    ("https://example.com/a?id=5&p=2", "https://example.com/a?id=5&p=2"), ("not a url", "not a url"), ("", ""),
    ("https://example.com/a?UTM_Source=x&q=", "https://example.com/a?q=")])
def test_normalize_url(spark, raw, clean):
    assert value(spark, urls.normalize_url(F.lit(raw))) == clean


@pytest.mark.parametrize("raw,seconds", [
    ("Tue, 30 Jan 2024 10:00:00 GMT", 1706608800), ("30 Jan 2024 10:00 +0530", 1706589000),
    ("2024-01-30T10:00:00Z", 1706608800), ("2024-01-30T10:00:00", 1706608800), ("2024-01-30", 1706572800),
    ("2024-01-30T10:00:00+0530", 1706589000), ("soon", None), ("", None)])
def test_parse_ts(spark, raw, seconds):
    assert value(spark, F.unix_seconds(dates.parse_ts(F.lit(raw)))) == seconds


def test_unescape(spark):
    assert value(spark, text.unescape(F.lit("a &amp;lt; &#8217;b&#39; &eacute;"))) == "a &lt; ’b' é"
    for raw in ("&copy 2024", "&notit; &notin; &not", "&#65 &#x41g", "AT&T R&D &;", "&ltd &eacutee &hellip", "&amp;amp; &ampx"):
        assert value(spark, text.unescape(F.lit(raw))) == html.unescape(raw)


def test_publishers(spark):
    def entity(n, u):
        return value(spark, labels.publisher_entity(F.lit(n), F.lit(u)))

    assert entity("The Hindu Tamil Nadu", "") == "the_hindu"
    assert entity("", "https://www.bbc.com/news") == "bbc"
    assert entity("Some Blog", "https://news.google.com/x") == "aggregator_unresolved"
    assert entity("Blog", "https://www.blog.example/x") == "domain:blog.example"
    assert entity("Blog", "") == "name:blog"
    assert entity("", "") == "unknown"


def test_paragraphs(spark):
    s = "One is here. Two is here. Three is here. Four is here. Five is here."
    assert value(spark, text.format_paragraphs(F.lit(s))).count("\n\n") == 2
    assert value(spark, text.format_paragraphs(F.lit("One. Two."))) == "One. Two."
