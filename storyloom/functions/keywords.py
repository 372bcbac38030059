"""Keyword sets, keyword overlap and term hits."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions.text import WORD_CHARS, rx, text_or_empty


def words(c) -> Column:
    """All Unicode word runs of the lower-case text."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(f"[{WORD_CHARS}]+"), F.lit(0))


def keywords(c, stopwords=K.WORKER_STOPWORDS) -> Column:
    """Distinct ASCII words of three or more characters outside the stop list."""
    kept = F.filter(words(c), lambda w: w.rlike("^[a-z0-9]{3,}$"))
    return F.array_except(kept, F.array(*[F.lit(w) for w in stopwords]))


def keyword_overlap(a, b) -> Column:
    """Size of the intersection of two keyword arrays."""
    return F.size(F.array_intersect(a, b))


def keyword_jaccard(a, b) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(
        (F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)
    ).otherwise(F.size(F.array_intersect(a, b)) / union)


def impact_hits(c, terms=K.WORKER_IMPACT_TERMS) -> Column:
    """Number of listed terms that occur at word bounds."""
    low = F.lower(text_or_empty(c))
    total = F.lit(0)
    for term in terms:
        total = total + low.rlike(rx(r"\b" + term + r"\b")).cast("int")
    return total


def term_counts(c, stop_words=()) -> Column:
    """Vector tokens of a text, each as often as it occurs: Unicode words of two or more lower-case characters."""
    # white space is no part of a word, so that of ``norm`` need not be found first
    tokens = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(f"[{WORD_CHARS}]{{2,}}"), F.lit(0))
    if stop_words:
        tokens = F.filter(tokens, lambda w: ~w.isin(list(stop_words)))
    return tokens
