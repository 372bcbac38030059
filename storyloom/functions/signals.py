"""Cheap gates in front of the score patterns.

A score reads some fifty patterns, nearly all of them lists of phrases.  Each
phrase needs a certain word, so one pass over the text's words tells which
patterns can match at all; only those are tried.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions.keywords import words
from storyloom.functions.text import rx


def _alternatives(pattern: str) -> list[str]:
    """Top-level alternatives of a ``\\b(a|b|c)\\b`` pattern."""
    body = re.fullmatch(r"\\b\((.*)\)\\b", pattern)
    if not body:
        return [pattern]
    out, depth, start, text = [], 0, 0, body.group(1)
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return out + [text[start:]]


def needed(pattern: str) -> tuple[set, set] | None:
    """(words, substrings) of which a matching text has at least one; None if unknown."""
    whole, parts = set(), set()
    for alt in _alternatives(pattern):
        wild = re.match(r"([a-z]{4,})\.\*", alt)
        word = re.match(r"([a-z]+)(?=$|[ /-])", alt)
        group = re.match(r"\\d\S*\\s\+\(([a-z|]+)\)$", alt)
        if wild:
            parts.add(wild.group(1))
        elif word:
            whole.add(word.group(1))
        elif group:
            whole.update(group.group(1).split("|"))
        else:
            return None
    return whole, parts


PATTERNS = [
    K.NOTABLE_PERSON, K.MASS_HARM, K.ISOLATED, K.WIDE_HARM, K.FATAL_ACCIDENT, K.LOCAL_SAFETY, K.BUSINESS_ROUTINE,
    K.CYBER, K.CYBER_ESSENTIAL, K.EMERGENCY_NOW, K.CRISIS, K.ANNOUNCED_TODAY, K.PROCEDURE, K.RETROSPECTIVE,
    K.LIFESTYLE,
    *[row[0] for ladder in (
        K.HUMAN_LADDER, K.SAFETY_LADDER, K.GEOGRAPHIC_LADDER, K.ECONOMIC_LADDER, K.POLICY_LADDER,
        K.INFRASTRUCTURE_LADDER, K.SECURITY_LADDER, K.CONSEQUENCE_LADDER) for row in ladder],
]
CASUALTY_WORDS = {
    "claim", "claims", "claimed", "toll", "died", "dead", "killed", "fatalities", "deaths", "lives"}
GATE_WORDS = sorted(CASUALTY_WORDS.union(*[n[0] for n in map(needed, PATTERNS) if n]))


def signal_words(text: Column) -> Column:
    """The gate words a lower-case text has."""
    return F.array_intersect(words(text), F.array(*[F.lit(w) for w in GATE_WORDS]))


class Signals:
    """Lower-case text with its gate words; ``has`` tries a pattern when it can match."""

    def __init__(self, text: Column, found: Column | None = None):
        self.text = text
        self.found = signal_words(text) if found is None else found

    def any_word(self, terms) -> Column:
        return F.arrays_overlap(self.found, F.array(*[F.lit(t) for t in sorted(terms)]))

    def has(self, pattern: str) -> Column:
        test = self.text.rlike(rx(pattern))
        need = needed(pattern)
        if need is None:
            return test
        gate = self.any_word(need[0]) if need[0] else F.lit(False)
        for part in sorted(need[1]):
            gate = gate | F.contains(self.text, F.lit(part))
        return gate & test

    def evacuation(self) -> Column:
        """An evacuation that is no drill, plan or protocol."""
        return F.contains(self.text, F.lit("evacuat")) & self.text.rlike(rx(K.EVACUATION + K.EVACUATION_EXCLUDED))
