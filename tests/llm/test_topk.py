import numpy as np
import pytest

from storyloom.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, rank int, score long"


def brute(rows, asked, k):
    good = [(i, np.floor(64 * np.array(e, float))) for i, e in rows if i is not None and e is not None
            and all(x is not None and np.isfinite(x) for x in e)]
    width = max(len(e) for _, e in good)
    good = [(i, np.pad(e, (0, width - len(e)))) for i, e in good]
    out = []
    for q, e in good:
        if asked(q):
            found = sorted((-int(e @ f), i) for i, f in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, asked, k):
    df = spark.createDataFrame([(i, e, 1, 2) for i, e in rows], SCHEMA)
    out = T.search(df, df.where(asked), k)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect())


def test_ties_and_edges(spark, monkeypatch):
    monkeypatch.setattr(T, "ROWS", 40)
    monkeypatch.setattr(T, "QUERIES", 7)
    rng = np.random.default_rng(6)
    rows = [(i * 3, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(120)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # very many ties, ids far apart
    rows += [(5_000_000_000, rows[5][1]), (None, rows[0][1]), (900, None), (901, [None] * 8), (902, [float("nan")] * 8),
             (903, [float("inf")] + [0.0] * 7), (904, []), (905, [0.5, 0.25])]
    assert run(spark, rows, "vec_id % 5 = 0", 20) == brute(rows, lambda i: i % 5 == 0, 20)


def test_few_and_none(spark):
    rows = [(1, [0.5]), (2, [1.5]), (3, [-1.0])]
    assert run(spark, rows, "vec_id = 1", 20) == [(1, 1, 2, 32 * 96), (1, 2, 3, -32 * 64)]
    assert run(spark, rows, "vec_id = 9", 20) == []
    assert run(spark, [], "vec_id = 9", 20) == []


def test_scores_too_large(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, [1e20]), (2, [1e20])], "vec_id = 1", 1)
