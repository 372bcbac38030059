import hashlib
import random
from collections import Counter

import pytest
from conftest import frame

from storyloom.llm import decontamination as D


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long, term string")


def test_phrases_short_items_and_edges(spark, edge, none):
    bench = items(spark, [(1, "zz TWO three, four five six seven eight nine ten eleven", 0, "t"), (2, None, 0, "t"), (3, " .. ", 0, "t"),
                          (4, "alpha beta", 0, "t"), (5, "one two three", 0, "t"), (5, "one two three", 0, "t")])
    got = {(r.doc_id, r.n_words): r for r in D.contamination(edge, bench).collect()}
    assert len(got) == 10  # the two rows of id 7 are equal
    seven = got[7, 12]
    assert (seven.n_hit, seven.n_items, seven.contaminated) == (11, 2, True)
    assert seven.items_sha256 == hashlib.sha256(b"1,5").hexdigest()
    assert got[3, 2].n_hit == got[6, 2].n_hit == 2 and (got[None, 5].n_hit, got[None, 5].n_items) == (3, 1)
    assert not got[0, 0].contaminated and got[0, 0].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert sorted(str(r.doc_id) for r in D.clean(edge, bench).collect()) == sorted(map(str, [0, 1, 2, 4, 5, 9]))
    assert D.clean(edge, bench).columns == edge.columns
    assert D.contamination(none, bench).count() == 0
    assert not any(r.contaminated for r in D.contamination(edge, bench.where("item_id > 99")).collect())


def test_rows_that_share_an_id_or_have_none(spark):
    text = "zz two three four five six seven eight nine ten eleven"
    rows = frame(spark, [(7, text, "s"), (7, "x", "s"), (None, text, "s"), (None, "y", None), (None, None, "s")])
    got = sorted((str(r.doc_id), r.n_words, r.n_hit) for r in D.contamination(rows, items(spark, [(1, text, 0, "t")])).collect())
    assert got == [("7", 1, 0), ("7", 11, 11), ("None", 0, 0), ("None", 1, 0), ("None", 11, 11)]
    assert D.clean(rows, items(spark, [(1, text, 0, "t")])).count() == 3


def test_proximity_against_plain_version(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    asked = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))), 0, "t") for i in range(12)]
    often = Counter(w for t in texts for w in t.split())
    got = {r.doc_id: r.n_near for r in D.contamination(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), items(spark, asked), 4, 2).collect()}
    for i, text in enumerate(texts):
        words, near = text.split(), set()
        for item, query, *_ in asked:
            q = query.split()
            for a in range(max(1, len(q) - 3)):
                win = q[a:a + 4]
                rare, away = min(win, key=lambda w: (often[w], w)), len(win) + 1
                near |= {item for at, w in enumerate(words) if w == rare
                         and not Counter(win) - Counter(words[max(at - away, 0):at + away + 1])}
        assert got[i] == len(near)


def test_proximity_ignores_order(spark, edge):
    asked = spark.createDataFrame([(["five", "four", "two"],)], "words array<string>")
    index = D.Index(edge, asked, 6)
    assert {r.row.id for r in index.proximity(slack=2).select("row").distinct().collect()} == {"7", ""}
    assert index.phrases().count() == 0
    with pytest.raises(ValueError):
        index.proximity(slack=9)
