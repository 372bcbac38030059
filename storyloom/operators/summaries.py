"""Grounded summaries: text drawn from the articles of a story, nothing invented."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions.text import clean_html_text, clean_text, let, rx, strip, text_or_empty, token_count, unescape

MIN_EXTRA = 15


def snippet_of(lead: Column, summary: Column) -> Column:
    """What an article adds to the lead headline, or NULL.

    A summary that starts with the headline keeps the rest when that is long
    enough; one that equals it adds nothing.
    """
    s = strip(F.regexp_replace(clean_text(summary), rx(r"\s+-\s+[^-]+$"), ""))
    s = strip(F.regexp_replace(s, "&nbsp;&nbsp;.*$", ""))

    def choose(t):
        low, head = F.lower(t), F.lower(lead)
        rest = F.regexp_replace(F.substr(t, F.length(lead) + 1), r"^[ .\-:\t\n]+|[ .\-:\t\n]+$", "")
        return (
            F.when((t == "") | (low == head), F.lit(None).cast("string"))
            .when(F.startswith(low, head), F.when(F.length(rest) > MIN_EXTRA, rest))
            .when(~F.contains(low, head), t)
            .when(F.length(t) > F.length(lead) + MIN_EXTRA, t)
        )

    return let(s, choose)


def extractive_summaries(articles: DataFrame, key: str = "cluster_id", order: str = "ord") -> DataFrame:
    """Headline, summary and three facts per story.

    Snippets are reduced to the first three distinct ones per story by ranking,
    so that nothing grows with the size of a story.
    """
    from storyloom.operators.feed import cap_per_group, first_per

    rows = articles.select(
        key, F.col(order).alias("_o"), clean_text("title").alias("_title"), "source", F.col("summary").alias("_s"),
        F.coalesce("category", F.lit("national")).alias("_cat"))
    lead = rows.groupBy(key).agg(F.min_by(F.struct("_title", "_cat"), "_o").alias("_l")).select(
        key, F.col("_l._title").alias("lead"), F.col("_l._cat").alias("category"))
    names = rows.filter(text_or_empty(F.col("source")) != "").groupBy(key, "source").agg(F.min("_o").alias("_o"))
    n_sources = names.groupBy(key).agg(F.count(F.lit(1)).alias("n_sources"), F.min_by("source", "_o").alias("first_source"))
    named = cap_per_group(names, key, ["_o"], 3).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_o", "source")))["source"].alias("first_sources"))

    found = rows.join(lead, key).select(key, "_o", snippet_of(F.col("lead"), F.col("_s")).alias("snippet")).filter(
        "snippet is not null")
    distinct = first_per(found, [key, "snippet"], ["_o"])
    top = cap_per_group(distinct, key, ["_o"], 3).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_o", "snippet")))["snippet"].alias("snippets"))

    joined = lead.join(n_sources, key, "left").join(named, key, "left").join(top, key, "left")
    empty = F.array().cast("array<string>")
    sn, src = F.coalesce("snippets", empty), F.array_join(F.coalesce("first_sources", empty), ", ")
    first = F.get(sn, F.lit(0))
    opening = F.when(F.contains(F.lower(first), F.lower("lead")), first).otherwise(F.concat("lead", F.lit(". "), first))
    with_text = F.concat_ws("\n\n", opening, F.array_join(F.slice(sn, 2, 2), "\n\n"))
    with_text = F.when(F.size(sn) > 1, with_text).otherwise(opening)
    without = F.when(src != "", F.concat("lead", F.lit(". Reported by "), src, F.lit("."))).otherwise(
        F.concat("lead", F.lit(".")))
    n = F.coalesce("n_sources", F.lit(0))
    backing = (
        F.when(n > 1, F.concat(F.lit("Corroborated across "), n.cast("string"), F.lit(" sources: "), src, F.lit(".")))
        .when(n == 1, F.concat(F.lit("Reported by "), "first_source", F.lit(".")))
    )
    filler = F.concat(F.lit("Category: "), F.initcap("category"))
    facts = F.slice(F.concat(
        F.array_compact(F.array(F.substring("lead", 1, 100), backing)),
        F.transform(F.slice(sn, 1, 2), lambda s: F.substring(s, 1, 100)), F.array(filler, filler)), 1, 3)
    return joined.select(
        key, F.substring("lead", 1, 100).alias("headline"),
        F.when(F.size(sn) > 0, with_text).otherwise(without).alias("summary"), facts.alias("key_facts"))


def article_summary(title, snippet, source, state) -> Column:
    """One-article variant: (summary, key facts, words)."""
    head = strip(F.regexp_replace(text_or_empty(title), rx(r"\s+-\s+[^-]+$"), ""))
    raw = unescape(strip(F.regexp_replace(text_or_empty(snippet), r"<[^>]+>", " ")))
    clean = strip(F.regexp_replace(raw, rx(r"\s+-\s+[^-]+$"), ""))
    src = F.when(text_or_empty(source) != "", source).otherwise(F.lit("Verified Wire"))
    st = F.when(text_or_empty(state) != "", state).otherwise(F.lit("National"))

    def build(v):
        h, c = v["h"], v["c"]
        other = (c != "") & (F.lower(c) != F.lower(h))
        text = (
            F.when(other & (F.length(c) > 15) & ~F.contains(F.lower(c), F.lower(h)), F.concat(h, F.lit(". "), c))
            .when(other & (F.length(c) > 15), c)
            .otherwise(F.concat(F.lit("Reporting from "), src, F.lit(": "), h, F.lit(".")))
        )
        last = F.when(other & (F.length(c) > 20), F.substring(c, 1, 100)).otherwise(F.concat(F.lit("Region: "), st))
        return F.struct(
            text.alias("summary"),
            F.array(F.substring(h, 1, 100), F.concat(F.lit("Source: "), src), last).alias("key_facts"),
            token_count(text).alias("words"))

    return let(F.struct(head.alias("h"), clean.alias("c")), build)


def live_summary(headline, snippet, source, state, items) -> Column:
    """Live variant: (summary, key facts, words) of one landed item.

    ``items`` are the (headline, publisher) entries of a coverage list, empty where the snippet is none: then up to two
    angles other than the headline make the summary. Else the snippet without the headline does, if it says more.
    """
    def said(template, *parts):
        return F.format_string(template, *parts)

    head = strip(F.regexp_replace(text_or_empty(headline), rx(r"\s+-\s+[^-]+$"), ""))
    plain = clean_html_text(snippet)
    plain = F.when(F.contains(plain, F.lit(" - ")), strip(F.regexp_replace(plain, rx(r"\s+-\s+[^-]+$"), ""))).otherwise(plain)
    src = text_or_empty(source)
    place = F.when(text_or_empty(state) != "", state)
    values = F.struct(head.alias("h"), plain.alias("c"), F.coalesce(items, F.array().cast("array<struct<headline:string,publisher:string>>")).alias("items"))

    def listed(v):
        low = F.lower(v["h"])
        angles = F.filter(v["items"], lambda i: ~F.contains(F.lower(i["headline"]), low) & ~F.contains(low, F.lower(i["headline"])))
        named = F.filter(F.transform(v["items"], lambda i: i["publisher"]), lambda p: p != "")
        names = F.array_join(F.slice(F.array_distinct(F.concat(named, F.when(src != "", F.array(src)).otherwise(F.array().cast("array<string>")))), 1, 3), ", ")

        def tell(w):
            one, two = (F.get(w["angles"], F.lit(i))["headline"] for i in (0, 1))
            body = F.when(F.size(w["angles"]) == 0, said(K.LIVE_DOSSIER, src)).otherwise(F.concat(
                said(K.LIVE_ACROSS, w["names"], one), F.when(F.size(w["angles"]) > 1, said(K.LIVE_FURTHER, two)).otherwise("")))
            facts = F.transform(F.slice(w["angles"], 1, 2), lambda i: F.concat(
                F.substring(i["headline"], 1, 100), F.when(i["publisher"] != "", F.concat(F.lit(" ("), i["publisher"], F.lit(")"))).otherwise("")))
            backing = said(K.LIVE_CORROBORATED, F.when(w["names"] != "", w["names"]).otherwise(src))
            return F.struct(body.alias("summary"), F.slice(F.concat(facts, F.array(backing)), 1, 3).alias("key_facts"))

        return let(F.struct(angles.alias("angles"), names.alias("names")), tell)

    def single(v):
        begins = F.startswith(F.lower(v["c"]), F.lower(v["h"]))
        rest = F.regexp_replace(strip(F.substr(v["c"], F.length(v["h"]) + 1)), r"^[.:\-\u2013\u2014,\s]+", "")

        def tell(c):
            more = (c != "") & (F.lower(c) != F.lower(v["h"]))
            body = F.when(more & (F.length(c) > 25), c).when(place.isNotNull(), said(K.LIVE_REGIONAL, place, src)).otherwise(said(K.LIVE_PLAIN, src))
            # a fourth fact is never shown
            facts = F.array(F.substring(v["h"], 1, 110), F.concat(F.lit("Source: "), src),
                            F.concat(F.lit("Region: "), F.coalesce(place, F.lit("National / Global"))))
            return F.struct(body.alias("summary"), facts.alias("key_facts"))

        return let(F.when(begins, strip(rest)).otherwise(v["c"]), tell)

    out = let(values, lambda v: F.when(F.size(v["items"]) > 0, listed(v)).otherwise(single(v)))
    return let(out, lambda o: F.struct(o["summary"].alias("summary"), o["key_facts"].alias("key_facts"), token_count(o["summary"]).alias("words")))
