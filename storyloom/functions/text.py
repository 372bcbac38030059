"""Text normalisation and measurement as Column expressions."""

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom import constants as K

# A maximal run of these is a word in the Unicode sense of ``\w+``.
WORD_CHARS = r"\p{L}\p{N}_"

def rx(pattern: str) -> str:
    """Give a pattern Unicode-aware word, digit and space classes."""
    return "(?U)" + pattern


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row, however often later ones use them: a generator is never merged with those."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def text_or_empty(c) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def strip(c) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(_col(c), rx(r"^\s+|\s+$"), "")


def collapse(c) -> Column:
    return strip(F.regexp_replace(_col(c), rx(r"\s+"), " "))


def norm(c) -> Column:
    """Single-spaced, trimmed, lower-case text; NULL counts as empty."""
    return F.lower(collapse(text_or_empty(c)))


def _references() -> dict[str, str]:
    """All standard character references, and the numbers that stand for Windows characters, by what follows the ampersand."""
    out = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}
    for code in range(0x80, 0xA0):
        out[f"#{code}"] = bytes([code]).decode("cp1252", "replace") if code not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(code)
    return out


_REFERENCES = json.dumps(_references())
#: The names that count without their semicolon, the longest first, as the longest one that fits is meant.
_OPEN = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n)))


def unescape(c) -> Column:
    """Decode character references, each once: decimal, hexadecimal and all standard names.

    Numbers and the standard's older names count without their semicolon too (``&copy 2024``), the longest name that fits. A
    number that is no character gives the replacement character; an unknown name stays as it is.
    """
    out = _col(c)
    known = F.from_json(F.lit(_REFERENCES), "map<string,string>")

    def decode(part):
        def number(name):
            is_hex = F.lower(F.substring(name, 1, 2)) == "#x"
            code = F.when(is_hex, F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8)).cast("int")

            def char(n):
                real = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
                plain = F.when(real, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(chr(0xFFFD))
                return F.coalesce(F.try_element_at(known, F.concat(F.lit("#"), n.cast("string"))), plain)

            return let(code, char)

        def spelled(written):
            """The written reference and its character, or the ampersand and nothing."""
            name = F.rtrim(written, F.lit(";"))
            char = F.when(F.startswith(written, F.lit("#")), number(name)).when(written != "", F.try_element_at(known, name))
            return F.concat(F.coalesce(char, F.lit("&")), F.substr(part, F.when(char.isNull(), 0).otherwise(F.length(written)) + 1))

        def closed_or_open(closed):
            whole = (closed != "") & (F.startswith(closed, F.lit("#")) | F.try_element_at(known, F.rtrim(closed, F.lit(";"))).isNotNull())
            return let(F.when(whole, closed).otherwise(F.regexp_extract(part, rf"^(#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|{_OPEN})", 1)), spelled)

        found = F.regexp_extract(part, r"^((?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)", 1)
        return F.when(part.rlike("^[A-Za-z#]"), let(found, closed_or_open)).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(out, "&")
    whole = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), decode), ""))
    return F.when(F.contains(out, F.lit("&")), whole).otherwise(out)


def strip_html_basic(c) -> Column:
    spaced = F.regexp_replace(text_or_empty(c), r"<[^>]+>", " ")
    return strip(F.replace(spaced, F.lit("&nbsp;"), F.lit(" ")))


def _replace_all(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


CRAWL_PUNCTUATION = [
    ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'),
    ("–", "-"), ("—", " - "), ("…", "..."), ("�", ""),
]
LIVE_PUNCTUATION = [
    ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'),
    ("–", "-"), ("—", " - "), (" ", " "), ("�", "'"),
]


def clean_text(c) -> Column:
    """Tags out, then references decoded, ASCII punctuation, single spaces."""
    out = unescape(F.regexp_replace(text_or_empty(c), r"<[^>]+>", " "))
    return collapse(_replace_all(out, CRAWL_PUNCTUATION))


def clean_html_text(c) -> Column:
    """As clean_text, but references are decoded before tags are removed."""
    out = F.regexp_replace(unescape(text_or_empty(c)), r"<[^>]+>", " ")
    out = F.replace(out, F.lit("&nbsp;"), F.lit(" "))
    return collapse(_replace_all(out, LIVE_PUNCTUATION))


def clean_chat_text(c) -> Column:
    """Tags out, references decoded, single spaces; punctuation kept."""
    return collapse(unescape(F.regexp_replace(text_or_empty(c), r"<[^>]+>", " ")))


def strip_paywall(c) -> Column:
    out = text_or_empty(c)
    for pattern in K.PAYWALL_PATTERNS:
        out = F.regexp_replace(out, "(?isU)" + pattern, "")
    return strip(out)


def clean_title(c) -> Column:
    """Headline without a trailing " - Publisher"."""
    return F.regexp_replace(_col(c), rx(r"\s+-\s+[^-]+$"), "")


def extract_publisher(title, default, feed_source=None) -> Column:
    """Publisher from the feed, else the short last " - " part, else a default."""
    title = text_or_empty(title)
    tail = F.substring_index(title, " - ", -1)
    guess = F.when(
        F.contains(title, F.lit(" - ")) & (F.length(tail) < 35), strip(tail)
    ).otherwise(_col(default))
    if feed_source is None:
        return guess
    given = strip(text_or_empty(feed_source))
    return F.when(given != "", given).otherwise(guess)


def headline_key(c) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(c)), r"[^a-z0-9]", "")


def word_tokens(c) -> Column:
    """Space-separated tokens."""
    parts = F.split(strip(text_or_empty(c)), rx(r"\s+"))
    return F.filter(parts, lambda w: w != "")


def token_count(c) -> Column:
    return F.size(word_tokens(c)).cast("bigint")


def word_count(c) -> Column:
    """Matches of a word-bounded run of word characters and apostrophes."""
    return F.regexp_count(text_or_empty(c), F.lit(rx(r"\b[\w']+\b"))).cast("bigint")


def sentence_count(c) -> Column:
    parts = F.split(text_or_empty(c), r"[.!?]+")
    return F.size(F.filter(parts, lambda p: p.rlike(rx(r"\S")))).cast("bigint")


def syllable_count(c) -> Column:
    """Vowel groups, at least one per word."""
    words = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"[\p{L}']+"), F.lit(0))
    groups = F.transform(
        words, lambda w: F.greatest(F.regexp_count(w, F.lit("[aeiouy]+")), F.lit(1))
    )
    return F.aggregate(groups, F.lit(0).cast("bigint"), lambda acc, n: acc + n)


def fk_grade(c) -> Column:
    """Flesch-Kincaid grade from the published formula and vowel-group syllables, to one decimal.

    It is computed in whole numbers, so that a grade just between two decimals is rounded away from zero and 0 has no sign.
    """
    words = F.size(
        F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"[\p{L}']+"), F.lit(0))
    ).cast("bigint")
    counts = F.struct(words.alias("w"), F.greatest(sentence_count(c), F.lit(1)).alias("s"), syllable_count(c).alias("y"))

    def grade(n):
        # 10 * (0.39 * w / s + 11.8 * y / w - 15.59) as a fraction
        above = 39 * n["w"] * n["w"] + 1180 * n["y"] * n["s"] - 1559 * n["s"] * n["w"]
        below = 20 * n["s"] * F.greatest(n["w"], F.lit(1))
        twice = 2 * F.abs(above) + 10 * n["s"] * n["w"]
        tenths = (twice - twice % below) / below
        return F.when(n["w"] > 0, F.when(above < 0, F.lit(0.0) - tenths).otherwise(tenths) / 10).otherwise(F.lit(0.0))

    return let(counts, grade)


def letter_tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"[a-z']+"), F.lit(0))


def has_any_token(c, terms) -> Column:
    return F.arrays_overlap(letter_tokens(c), F.array(*[F.lit(t) for t in terms]))


def token_hits(c, terms) -> Column:
    """The listed terms that occur as tokens, sorted."""
    return F.array_sort(
        F.array_intersect(F.array(*[F.lit(t) for t in sorted(terms)]), letter_tokens(c))
    )


def split_sentences(c) -> Column:
    return F.split(_col(c), rx(r"(?<=[.!?])\s+"))


def _laid_out(s: Column) -> Column:
    """Sentences as one, two or three paragraphs by their number."""
    n = F.size(s)

    def part(start, length):
        return F.array_join(F.slice(s, start, length), " ")

    half = F.floor(n / 2).cast("int")
    return (
        F.when(n <= 4, F.concat_ws("\n\n", part(F.lit(1), half), part(half + 1, n)))
        .otherwise(
            F.concat_ws("\n\n", part(F.lit(1), F.lit(2)), part(F.lit(3), F.lit(2)), part(F.lit(5), n))
        )
    )


def format_paragraphs(c) -> Column:
    """Keep given blank-line paragraphs, else lay sentences out in up to three."""
    raw = text_or_empty(c)
    given = F.filter(F.transform(F.split(raw, "\n\n"), clean_text), lambda p: p != "")

    def by_sentences(cleaned):
        return let(
            split_sentences(cleaned), lambda s: F.when(F.size(s) <= 2, cleaned).otherwise(_laid_out(s)))

    def with_given(paragraphs):
        return F.when(F.size(paragraphs) >= 2, F.array_join(paragraphs, "\n\n")).otherwise(
            let(clean_text(raw), by_sentences))

    return F.when(F.contains(raw, F.lit("\n\n")), let(given, with_given)).otherwise(
        let(clean_text(raw), by_sentences))


def first_words(c, n: int = 60) -> Column:
    """The first n words with an ellipsis, or the text itself when shorter."""
    raw = text_or_empty(c)
    words = F.split(strip(raw), rx(r"\s+"))
    return F.when(F.size(words) <= n, raw).otherwise(
        F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit("…"))
    )


def first_chars(c, n: int = 300) -> Column:
    """At most n characters, three of them dots when the text was longer."""
    raw = text_or_empty(c)
    cut = F.regexp_replace(F.substring(raw, 1, n - 3), rx(r"\s+$"), "")
    return F.when(F.length(raw) > n, F.concat(cut, F.lit("..."))).otherwise(raw)


def _bare(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^A-Za-z0-9_]", ""))


def _without_headline(h: Column, s: Column) -> Column:
    """The summary after a headline it starts with, word for word."""

    def by_words(w):
        hw, sw = w["h"], w["s"]
        nh = F.size(hw)
        same = F.forall(
            F.zip_with(hw, F.slice(sw, F.lit(1), nh), lambda a, b: _bare(a) == _bare(b)), lambda x: x)
        rest = F.slice(sw, nh + 1, F.greatest(F.size(sw) - nh, F.lit(0)))
        return F.when((nh >= 3) & (F.size(sw) > nh) & same, strip(F.array_join(rest, " "))).otherwise(s)

    split = F.struct(F.split(h, rx(r"\s+")).alias("h"), F.split(s, rx(r"\s+")).alias("s"))
    return F.when(F.startswith(F.lower(s), F.lower(h)), strip(F.substr(s, F.length(h) + 1))).otherwise(
        let(split, by_words))


def _without_doubled_opening(s: Column) -> Column:
    def drop(parts):
        first, second = _bare(F.get(parts, F.lit(0))), _bare(F.get(parts, F.lit(1)))
        doubled = (F.size(parts) >= 2) & (first != "") & (first == second)
        return F.when(doubled, strip(F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " "))).otherwise(s)

    return let(split_sentences(s), drop)


def clean_summary(headline, summary) -> Column:
    """Summary without a repeated headline, publisher prefix or doubled opening."""
    trimmed = F.struct(
        strip(text_or_empty(headline)).alias("h"), strip(text_or_empty(summary)).alias("s"))
    body = let(trimmed, lambda t: _without_headline(t["h"], t["s"]))
    body = strip(F.regexp_replace(body, rx("^[.:\\-–—,\\s]+"), ""))
    body = strip(F.regexp_replace(body, "(?iU)^(?:" + K.SUMMARY_PUBLISHERS + ")\\s*[:\\-–—.]*\\s*", ""))
    body = let(body, _without_doubled_opening)
    shown = let(body, lambda s: F.when(F.length(s) < 15, F.lit(K.SHORT_SUMMARY_TEXT)).otherwise(
        F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))))
    return F.when(text_or_empty(summary) == "", "").otherwise(shown)


def simplify(c) -> Column:
    """Plain-language form of the first 60 words."""
    out = first_words(c, 60)
    for pattern, plain in K.PLAIN_REWRITES:
        out = F.regexp_replace(out, "(?i)" + pattern, plain)
    return out


def lead_sentences(title, text, source) -> Column:
    """Extract of the first three full sentences, at most 85 words."""
    title, source = text_or_empty(title), text_or_empty(source)
    good = F.filter(
        F.transform(split_sentences(collapse(text_or_empty(text))), strip),
        lambda s: (F.length(s) > 20)
        & ~F.startswith(F.lower(s), F.lit("sign up"))
        & ~F.startswith(F.lower(s), F.lit("subscribe")),
    )
    monitored = F.lit(" Further details and verified reports are being monitored by ")
    none = F.lit(". Developments are actively being monitored and verified across"
                 " international correspondents and official sources.")

    def few(joined):
        return F.when(token_count(joined) < 40, F.concat(
            title, F.lit(". "), joined, monitored, source, F.lit("."))).otherwise(joined)

    def choose(g):
        return (
            F.when(F.size(g) >= 3, F.array_join(F.slice(g, 1, 3), " "))
            .when(F.size(g) >= 1, let(F.array_join(g, " "), few))
            .otherwise(F.concat(title, none))
        )

    def cut(out):
        def by_words(words):
            short = F.array_join(F.slice(words, 1, 85), " ")
            return F.when(F.size(words) <= 85, out).when(F.endswith(short, F.lit(".")), short).otherwise(
                F.concat(short, F.lit("...")))

        return let(word_tokens(out), by_words)

    return let(let(good, choose), cut)


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)
