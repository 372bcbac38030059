import random
import zlib
from fractions import Fraction
from hashlib import sha256

import pytest
from conftest import edge_rows, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from storyloom.llm import periodicruns, queries


def brute(words, least=6, times=4):
    """Every stretch that no neighbour extends at a period, with no smaller period."""
    n, out = len(words), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                part = words[i:j + q]
                if not any(all(part[x] == part[x + d] for x in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def runs_of(texts, least=6, times=4):
    import numpy as np

    seen = {}
    flat = np.array([seen.setdefault(w, len(seen)) for t in texts for w in t], np.int64)
    out = [[] for _ in texts]
    for t, *run in periodicruns.maximal_runs(flat, np.array([len(t) for t in texts], np.int64), least, times):
        out[t].append(tuple(run))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=4), st.integers(1, 9), st.integers(3, 5))
def test_random_words(texts, least, times):
    assert runs_of(texts, least, times) == [brute(t, least, times) for t in texts]


def test_planted_runs():
    rng, texts = random.Random(3), []
    for _ in range(150):
        block = [rng.choice("abc") for _ in range(rng.randint(1, 25))]
        body = (block * 9)[: rng.randint(4 * len(block) - 1, 6 * len(block))]
        texts.append([rng.choice("abc") for _ in range(rng.randint(0, 9))] + body + [rng.choice("abc") for _ in range(rng.randint(0, 9))])
    # every gram of the block stands in it twice, so only long grams tell its period
    texts.append(list("aabab" "babaa" "aabab" "babab") * 5)
    texts.append((list("ab") * 40 + ["x"]) * 5)
    assert runs_of(texts) == [brute(t) for t in texts]


def test_edges(spark, edge, none):
    rows = edge_rows()
    got = periodicruns.periodic_runs(edge).collect()
    assert len(got) == len(rows) and periodicruns.periodic_runs(none).count() == 0
    want = sorted((str(i), len(w), kept(w, brute(w) if len(w) < 99 else [])) for i, w in ((i, (t or "").split()) for i, t, _ in rows))
    assert sorted((str(r.doc_id), r.n_words, r.collapsed) for r in got) == want
    text = "x " + "ha " * 9 + "y\n" + "one  two\tthree " * 5 + "ha"
    (row,) = periodicruns.periodic_runs(frame(spark, [(1, text, "s")])).collect()
    assert [tuple(r) for r in row.runs] == [(1, 9, 1), (11, 15, 3)] and row.collapsed == "x ha y one two three ha"
    with pytest.raises(ValueError):
        periodicruns.maximal_runs(__import__("numpy").zeros(9, int), __import__("numpy").array([9]), 6, 2)


def test_query_against_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, folder).collect()}
    repeated = 0
    for doc in docs:
        words = (doc.text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        runs = brute(words) if n < 1500 else runs_of([words])[0]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        row = got.pop(doc.doc_id)
        assert row.n_runs == len(runs)
        assert (row.start, row.length, row.period) == (best or (None, None, None))
        assert row.exponent_milli == (best and 1000 * best[1] // best[2])
        assert row.runs_sha256 == sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        gone = {x for s, m, q in runs for x in range(s + q, s + m)}
        assert row.collapsed_sha256 == sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
        repeated += bool(runs)
    assert not got and repeated > 5
