from collections import defaultdict

from conftest import edge_rows, frame

from storyloom.llm import mixing


def want_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, out, open_ = sum(size.values()), {}, set(names)
    while True:
        rest = total - sum(out.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s] + 1e-9}
        if not over:
            return out | share
        out |= {s: 3.0 * size[s] for s in over}
        open_ -= over


def check(rows, got):
    size, docs = defaultdict(int), defaultdict(list)
    for i, t, s in rows:
        size[s] += len(t.encode().split()) if t else 0
    for r in got:
        docs[r.source].append(r)
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == size[r.source] and r.taken == r.copies * r["size"]
    assert len(got) == len(rows)
    for s, target in want_targets(size).items():
        assert all(abs(r.target - target) < 1e-6 * max(1, target) for r in docs[s])
        assert abs(sum(r.taken for r in docs[s]) - target) <= max(r["size"] for r in docs[s])


def test_edges(spark, edge, none):
    check(edge_rows(), mixing.mix(edge).collect())
    assert mixing.mix(none).count() == 0


def test_tree_is_stable_and_exact(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = [(i, "word " * (i * 37 % 90), "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    one = mixing.mix(frame(spark, rows).repartition(5)).collect()
    two = mixing.mix(frame(spark, rows[::-1]).coalesce(1)).collect()
    check(rows, one)
    assert sorted((r.doc_id, r.taken) for r in one) == sorted((r.doc_id, r.taken) for r in two)
    other = mixing.mix(frame(spark, rows), seed=5).collect()
    assert sorted((r.doc_id, r.taken) for r in one) != sorted((r.doc_id, r.taken) for r in other)
