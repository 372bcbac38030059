"""Categories, districts, wires, publishers and provenance classes."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions.text import rx, strip, text_or_empty
from storyloom.functions.urls import host_of


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def literal_list_map(values: dict) -> Column:
    pairs = []
    for key, items in values.items():
        pairs += [F.lit(key), F.array(*[F.lit(i) for i in items])]
    return F.create_map(*pairs)


def any_contains(c: Column, parts) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.contains(c, F.lit(part))
    return hit


def canonical_category(c) -> Column:
    """Canonical category; blank is National, unknown text passes through."""
    raw = text_or_empty(c)
    known = F.try_element_at(literal_map(K.CANONICAL_CATEGORY), F.lower(strip(raw)))
    return F.when(raw == "", F.lit("National")).otherwise(F.coalesce(known, strip(raw)))


def category_from_title(title, category) -> Column:
    """Category by headline keywords, else the given one if it is known."""
    low = F.lower(text_or_empty(title))
    given = F.lower(strip(text_or_empty(category)))
    out = None
    for label, terms in K.TITLE_CATEGORY_TERMS:
        value = F.lit(label)
        if label == "disaster":
            value = F.when(F.contains(low, F.lit("nepal")), F.lit("national")).otherwise(F.lit("state"))
        hit = any_contains(low, terms)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.when(given.isin(K.TITLE_CATEGORY_KEPT), given).otherwise(F.lit("national"))


def expand_category(c, synonyms=K.FEED_SYNONYMS) -> Column:
    """The category and its synonyms, lower case, as an array."""
    low = F.lower(strip(text_or_empty(c)))
    return F.array_union(
        F.array(low), F.coalesce(F.try_element_at(literal_list_map(synonyms), low), F.array(low))
    )


def categories_match(a, b, synonyms=K.CLIENT_SYNONYMS) -> Column:
    """Equal, or sharing a synonym."""
    low_a, low_b = F.lower(strip(text_or_empty(a))), F.lower(strip(text_or_empty(b)))
    table = literal_list_map(synonyms)

    def group(low):
        return F.coalesce(F.try_element_at(table, low), F.array(low))

    return (low_a != "") & ((low_a == low_b) | F.arrays_overlap(group(low_a), group(low_b)))


def extract_district(district, title, summary) -> Column:
    """Given district, else the word after "district" in the text."""
    given = F.lower(strip(text_or_empty(district)))
    text = F.lower(F.concat_ws(" ", text_or_empty(title), text_or_empty(summary)))
    return F.when(given != "", given).when(
        F.contains(text, F.lit("district")), F.regexp_extract(text, rx(r"\bdistrict\s+([a-z]+)\b"), 1)
    ).otherwise("")


def wire_of(c) -> Column:
    """First wire agency named in the opening 200 characters."""
    hit = F.regexp_extract(
        F.substring(text_or_empty(c), 1, 200), "(?iU)\\b(" + K.WIRE_AGENCIES + ")\\b", 1
    )
    return F.when(hit != "", F.upper(hit))


def has_wire_marker(c) -> Column:
    return any_contains(F.lower(text_or_empty(c)), K.WIRE_MARKERS)


def _entity_rules(name: Column, url: Column, rules, otherwise: Column) -> Column:
    out = None
    for key, parts, exact, url_parts in rules:
        hit = any_contains(name, parts) | any_contains(url, url_parts)
        if exact:
            hit = hit | name.isin(exact)
        out = F.when(hit, F.lit(key)) if out is None else out.when(hit, F.lit(key))
    return out.otherwise(otherwise)


def publisher_entity(name, url) -> Column:
    """Canonical publisher of a citation."""
    n, u = F.lower(strip(text_or_empty(name))), F.lower(strip(text_or_empty(url)))
    host = host_of(u)
    fallback = (
        F.when(host == "news.google.com", F.lit("aggregator_unresolved"))
        .when(host != "", F.concat(F.lit("domain:"), host))
        .otherwise(F.concat(F.lit("name:"), n))
    )
    return (
        F.when((n == "") & (u == ""), F.lit("unknown"))
        .when(any_contains(n, ["unresolved", "unknown"]), F.lit("unresolved"))
        .otherwise(_entity_rules(n, u, K.PUBLISHER_RULES, fallback))
    )


def scoring_publisher(name, url, tier) -> Column:
    """Publisher key of the trust score; NULL for sources that never count."""
    n, u = F.lower(strip(text_or_empty(name))), F.lower(strip(text_or_empty(url)))
    t = F.lower(strip(text_or_empty(tier)))
    skipped = (
        (n == "")
        | t.isin("3", "unresolved", "unknown", "legacy_unresolved")
        | F.contains(n, F.lit("unresolved"))
        | F.contains(u, F.lit("news.google.com"))
    )
    return F.when(~skipped, _entity_rules(n, u, K.SCORING_PUBLISHER_RULES, n))


def scoring_tier(name) -> Column:
    """1, 2 or 0 by substring tests on the publisher name."""
    n = F.lower(strip(text_or_empty(name)))
    return F.when(any_contains(n, K.SCORING_TIER_1), 1).when(any_contains(n, K.SCORING_TIER_2), 2).otherwise(0)


def url_type(url) -> Column:
    return F.when(
        F.contains(F.lower(text_or_empty(url)), F.lit("google")), F.lit("aggregator")
    ).otherwise(F.lit("direct"))


def provenance(source_id, name, url, tier) -> Column:
    """How well a citation's name and address agree."""
    n, u = F.lower(text_or_empty(name)), F.lower(strip(text_or_empty(url)))
    bbc_name, bbc_url = F.contains(n, F.lit("bbc")), F.contains(u, F.lit("bbc.co.uk"))
    nyt_url = F.contains(u, F.lit("nytimes.com"))
    return (
        F.when(
            (text_or_empty(source_id) == K.SENTINEL_SOURCE_ID)
            | (text_or_empty(tier) == "3")
            | F.contains(n, F.lit("unresolved")),
            F.lit("unresolved"),
        )
        .when(url_type(url) == "aggregator", F.lit("name_only_match"))
        .when(bbc_name & (bbc_url | F.contains(u, F.lit("bbci.co.uk"))), F.lit("verified_identity"))
        .when(F.contains(n, F.lit("the new york times")) & nyt_url, F.lit("verified_identity"))
        .when((bbc_url | nyt_url) & ~(bbc_name | F.contains(n, F.lit("new york times"))),
              F.lit("domain_conflict"))
        .otherwise(F.lit("name_only_match"))
    )


def is_sensitive_visual(c) -> Column:
    from storyloom.functions.text import has_any_token

    return has_any_token(c, K.SENSITIVITY) | has_any_token(c, K.VISUAL_SENSITIVE)


def visual_query(headline, summary, category) -> Column:
    """Stock-photo search words; NULL for sensitive stories."""
    h = F.lower(text_or_empty(headline))
    out = F.when(
        is_sensitive_visual(F.concat_ws(" ", text_or_empty(headline), text_or_empty(summary))),
        F.lit(None).cast("string"),
    )
    for terms, query in K.VISUAL_TOPICS:
        out = out.when(any_contains(h, terms), F.lit(query))
    by_category = F.try_element_at(literal_map(K.VISUAL_CATEGORIES), F.lower(text_or_empty(category)))
    return out.otherwise(F.coalesce(by_category, F.lit(K.VISUAL_DEFAULT)))
