import random
from collections import defaultdict

import numpy as np
from conftest import edge_rows, frame

from storyloom.llm import neardup as N


def brute(rows, k, percent):
    def grams(t):
        w = (t or "").encode().lower().split() if t else []
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [(i, grams(t)) for i, t, _ in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(None if i is None else find(i)), i is None or find(i) == i) for i, s in sets)


def run(df, k, percent):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in N.near_duplicates(df, k, percent).collect())


def test_edges(spark, edge, none):
    assert run(edge, 3, 85) == brute(edge_rows(), 3, 85)
    assert run(none, 5, 80) == []


def test_chains_and_a_large_group(spark):
    rng = random.Random(2)
    base = [f"t{rng.randint(0, 500)}" for _ in range(120)]
    rows = []
    for i in range(60):  # copies with edits of their own: many are linked with the base alone
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(120)] = f"e{rng.randint(0, 999)}"
        rows.append((100 - i, " ".join(own), "s"))
    chain = list(base[:100][::-1])
    for i in range(12):  # each next is near the one before only
        chain[i * 8] = f"c{i}"
        rows.append((200 + i, " ".join(chain), "s"))
    rows += [(300 + i, " ".join(f"n{i}{j}" for j in range(40)), "s") for i in range(20)]
    for k, percent in ((3, 85), (5, 80)):
        assert run(frame(spark, rows).repartition(3), k, percent) == brute(rows, k, percent)


def test_likelihood_is_near_the_similarity():
    rng = np.random.default_rng(1)
    from storyloom.llm.textblocks import mix

    for share in (0.5, 0.8, 0.95):
        both, own = int(400 * share), int(400 * (1 - share) / 2)
        found = []
        for _ in range(12):
            x = mix(rng.integers(0, 1 << 60, both + 2 * own).astype(np.uint64))
            a = np.concatenate([x[:both], x[both:both + own]])
            b = np.concatenate([x[:both], x[both + own:]])
            regs = N.registers(np.concatenate([a, b]), np.array([0, len(a)]))
            union = N.registers(np.concatenate([a, b]), np.array([0]))
            assert (np.maximum(regs[0], regs[1]) == union[0]).all()
            found.append(N.likely(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))[0])
        assert abs(np.mean(found) - both / (both + 2 * own)) < 0.04


def test_components(spark):
    from storyloom.llm.components import components
    from storyloom.session import Workspace

    rng = random.Random(4)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    links = [(a, b) for a, b in links if a != b]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [] if start in want else [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "test"))
    assert {r.node: r.root for r in got.collect()} == want
