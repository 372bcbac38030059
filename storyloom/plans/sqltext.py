"""Small SQL builders shared by the oracle texts (DuckDB dialect)."""

import re
from html.entities import html5

from storyloom import constants as K
from storyloom.functions import text as X


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def ascii_words(x: str) -> str:
    """Non-ASCII letters as x, so that ASCII word bounds act like Unicode ones."""
    return rf"regexp_replace({x}, '[^\P{{L}}a-zA-Z]', 'x', 'g')"


def words(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def keywords(x: str, stop) -> str:
    return (
        f"list_filter(list_distinct({words(x)}), lambda w: regexp_matches(w, '^[a-z0-9]{{3,}}$') "
        f"AND NOT list_contains({lits(stop)}, w))"
    )


def contains_any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(p)})" for p in parts) + ")"


def unescape(x: str) -> str:
    """The references that the tables hold; the query character_references plants others."""
    for name in ("lt", "gt", "quot", "apos", "nbsp", "copy", "middot", "hellip", "ndash", "mdash", "lsquo", "rsquo", "ldquo", "rdquo", "eacute"):
        x = f"replace({x}, '&{name};', {lit(html5[name + ';'])})"
    return f"replace({x}, '&amp;', '&')"


def _of_step(x: str) -> str:
    return re.sub(r"\b([kn])\b(?!')", r"s.\1", x)


#: One row with the standard's references by name, and the numbers that stand for Windows characters; for ``decode``.
REFERENCES = "refs AS (SELECT MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in X._references().items()) + "} AS known)"


def decode(x: str) -> str:
    """All references, each once, also those that lack their semicolon: the rule of ``text.unescape``. Needs REFERENCES as ``refs`` in FROM."""
    closed = "regexp_extract(p, '^((?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)', 1)"
    opened = f"regexp_extract(p, '^(#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|{X._OPEN})', 1)"
    # steps of one part: p after the ampersand, w the reference as written, n its name, k its number
    written = f"""CASE WHEN {closed} <> '' AND (starts_with(p, '#') OR known[rtrim({closed}, ';')] IS NOT NULL) THEN {closed} ELSE {opened} END"""
    number = "CASE WHEN starts_with(lower(n), '#x') THEN CAST('0x' || substr(n, 3) AS INT) WHEN starts_with(n, '#') THEN CAST(substr(n, 2) AS INT) END"
    char = """CASE WHEN k IS NULL THEN known[n] WHEN known['#' || k] IS NOT NULL THEN known['#' || k]
      WHEN k > 0 AND k < 1114112 AND k NOT BETWEEN 55296 AND 57343 THEN chr(k) ELSE chr(65533) END"""
    steps = f"[{{'p': p, 'w': {written}}}]"
    steps = f"list_transform({steps}, lambda s: {{'p': s.p, 'w': s.w, 'n': rtrim(s.w, ';')}})"
    steps = f"list_transform({steps}, lambda s: {{'p': s.p, 'w': s.w, 'n': s.n, 'k': {_of_step(number)}}})"
    steps = f"list_transform({steps}, lambda s: {{'p': s.p, 'w': s.w, 'c': {_of_step(char)}}})"
    part = f"list_transform({steps}, lambda s: CASE WHEN s.c IS NULL THEN '&' || s.p ELSE s.c || substr(s.p, length(s.w) + 1) END)[1]"
    return f"(string_split({x}, '&')[1] || array_to_string(list_transform(string_split({x}, '&')[2:], lambda p: {part}), ''))"


def replace_all(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, {lit(old)}, {lit(new)})"
    return x


def clean_text(x: str) -> str:
    tagless = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')"
    return collapse(replace_all(unescape(tagless), X.CRAWL_PUNCTUATION))


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def hits(x: str, terms) -> str:
    """Number of terms at word bounds in ASCII-folded lower-case text."""
    return "(" + " + ".join(f"CAST({matches(x, chr(92) + 'b' + t + chr(92) + 'b')} AS INT)" for t in terms) + ")"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z'']+')"


def word_count(x: str) -> str:
    return rf"len(regexp_extract_all({ascii_words(x)}, '\b[\w'']+\b'))"


def sentence_count(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({x}, '[.!?]+'), lambda p: regexp_matches(p, '\S')))"


def letter_words(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}'']+')"


def fk_grade(x: str) -> str:
    """In whole numbers: a grade just between two decimals goes away from zero, 0 has no sign."""
    w = letter_words(x)
    syl = f"list_sum(list_transform({w}, lambda t: greatest(len(regexp_extract_all(t, '[aeiouy]+')), 1)))"
    counts = f"[{{'w': len({w}), 's': greatest({sentence_count(x)}, 1), 'y': CAST(coalesce({syl}, 0) AS BIGINT)}}]"
    above = "(39 * n.w * n.w + 1180 * n.y * n.s - 1559 * n.s * n.w)"
    return (
        f"list_transform({counts}, lambda n: CASE WHEN n.w = 0 THEN 0.0::DOUBLE ELSE "
        f"(CASE WHEN {above} < 0 THEN -1 ELSE 1 END * ((2 * abs({above}) + 10 * n.s * n.w) // (20 * n.s * n.w)))::DOUBLE / 10 END)[1]"
    )


def sentences(x: str) -> str:
    """Split after . ! or ? followed by space (the mark stays)."""
    return rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def bare(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^A-Za-z0-9_]', '', 'g'))"


def canonical_category(x: str) -> str:
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in K.CANONICAL_CATEGORY.items())
    return f"(CASE WHEN coalesce({x}, '') = '' THEN 'National' ELSE CASE lower(trim({x})) {arms} ELSE trim({x}) END END)"


def entity_case(name: str, url: str, rules, otherwise: str) -> str:
    arms = []
    for key, parts, exact, urls in rules:
        conds = [f"contains({name}, {lit(p)})" for p in parts] + [f"contains({url}, {lit(u)})" for u in urls]
        conds += [f"{name} = {lit(e)}" for e in exact]
        arms.append(f"WHEN {' OR '.join(conds)} THEN {lit(key)}")
    return f"CASE {' '.join(arms)} ELSE {otherwise} END"


def host(url: str) -> str:
    return rf"regexp_replace(regexp_extract({url}, '^[a-z][a-z0-9+.\-]*://([^/?#]*)', 1), '^www\.', '')"


def publisher_entity(name: str, url: str) -> str:
    n, u = f"lower(trim(coalesce({name}, '')))", f"lower(trim(coalesce({url}, '')))"
    other = (
        f"CASE WHEN {host(u)} = 'news.google.com' THEN 'aggregator_unresolved' "
        f"WHEN {host(u)} <> '' THEN 'domain:' || {host(u)} ELSE 'name:' || {n} END"
    )
    return (
        f"(CASE WHEN {n} = '' AND {u} = '' THEN 'unknown' "
        f"WHEN contains({n}, 'unresolved') OR contains({n}, 'unknown') THEN 'unresolved' "
        f"ELSE {entity_case(n, u, K.PUBLISHER_RULES, other)} END)"
    )


def scoring_publisher(name: str, url: str, tier: str) -> str:
    n, u = f"lower(trim(coalesce({name}, '')))", f"lower(trim(coalesce({url}, '')))"
    return (
        f"(CASE WHEN {n} = '' OR lower(trim({tier})) IN ('3', 'unresolved', 'unknown', 'legacy_unresolved') "
        f"OR contains({n}, 'unresolved') OR contains({u}, 'news.google.com') THEN NULL "
        f"ELSE {entity_case(n, u, K.SCORING_PUBLISHER_RULES, n)} END)"
    )


def scoring_tier(name: str) -> str:
    n = f"lower(trim(coalesce({name}, '')))"
    return (f"(CASE WHEN {contains_any(n, K.SCORING_TIER_1)} THEN 1 "
            f"WHEN {contains_any(n, K.SCORING_TIER_2)} THEN 2 ELSE 0 END)")


def category_map(x: str, table: dict) -> str:
    """List of a literal list map, NULL when unknown."""
    arms = " ".join(f"WHEN {lit(k)} THEN {lits(v)}" for k, v in table.items())
    return f"(CASE {x} {arms} END)"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"
