import math
import zlib
from collections import Counter

import pytest
from conftest import edge_rows, frame

from storyloom.llm import ctw


class Plain:
    """Context-tree weighting with one dictionary and recursion."""

    def __init__(self, pieces, depth):
        self.depth, self.count, self.under = depth, Counter(), {}
        for (context, byte), n in pieces.items():
            for d in range(depth + 1):
                for j in range(8):
                    node = (context[:d], byte >> (8 - j), j)
                    self.count[node, byte >> (7 - j) & 1] += n
                    if d < depth:
                        self.under.setdefault(node, set()).add((context[:d + 1], byte >> (8 - j), j))
        self.known = {}

    def own(self, node):
        a, b = self.count[node, 0], self.count[node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def whole(self, node):
        if node not in self.known:
            own = self.own(node)
            if len(node[0]) == self.depth:
                self.known[node] = own
            else:
                rest = sum(self.whole(x) for x in self.under[node])
                self.known[node] = max(own, rest) + math.log1p(math.exp(-abs(own - rest))) - math.log(2)
        return self.known[node]

    def bit(self, context, d, head, j, bit):
        node = (context[:d], head, j)
        a, b = self.count[node, 0], self.count[node, 1]
        if a + b == 0:
            return 0.5
        kt = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == self.depth:
            return kt
        w = math.exp(self.own(node) - math.log(2) - self.whole(node))
        return w * kt + (1 - w) * self.bit(context, d + 1, head, j, bit)

    def log10(self, context, byte):
        return sum(math.log10(self.bit(context, 0, byte >> (8 - j), j, byte >> (7 - j) & 1)) for j in range(8))


def pieces(words):
    text = b" ".join(words) + bytes([ctw.END])
    for i, b in enumerate(text):
        yield tuple((text[i - d] if i - d >= 0 else ctw.START) for d in range(1, ctw.DEPTH + 1)), b


def brute(rows):
    texts = [(i, (t or "").encode().lower().split() if t else [], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t, _ in rows]
    seen, shapes = Counter(), Counter()
    for _, words, held in texts:
        if not held:
            seen.update([*words, None])
            shapes.update(pieces(words))
    model = Plain(shapes, ctw.DEPTH)
    n, v = sum(seen.values()), len(seen)
    out = []
    for i, words, held in texts:
        tokens = [*words, None]
        base = sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in tokens)
        score = sum(model.log10(c, b) for c, b in pieces(words))
        out.append((str(i), held, len(tokens), sum(seen[x] > 0 for x in tokens), n, base, score))
    return sorted(out)


def check(df, rows):
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ctw.score(df).collect())
    want = brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-5)


def test_edges(spark, edge, none):
    rows = [r for r in edge_rows() if r[0] not in (4, 5)] + [(11, "the theta these Émile " * 40, "s"), (15, "unheard-of words here", "s")]
    check(frame(spark, rows).repartition(2), rows)
    assert ctw.score(none).count() == 0


def test_against_plain_version(spark, monkeypatch):
    monkeypatch.setattr(ctw, "BATCH_BYTES", 2000)
    monkeypatch.setattr(ctw, "FAN_IN", 2)
    monkeypatch.setattr(ctw, "ANSWER_BYTES", 300)
    import random

    rng = random.Random(3)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))), "s") for i in range(80)]
    check(frame(spark, rows).repartition(3), rows)
    lengths = {r.doc_id: r.bits_per_byte for r in ctw.code_length(frame(spark, rows)).collect()}
    assert all(x is None or 0 < x < 12 for x in lengths.values())


def test_word_order_counts(spark):
    """A sentence that is learnt many times is likelier than its words in another order, and than the add-one base."""
    sentence = "the quick brown fox jumps over the lazy dog"
    rows = [(i, sentence, "s") for i in range(300)] + [(1000, "dog lazy the over jumps fox brown quick the", "s")]
    got = {r.doc_id: r for r in ctw.score(frame(spark, rows)).collect()}
    held = next(r for i, r in got.items() if r.held_out and i < 1000)
    assert held.score > got[1000].score + 5 and held.score > held.base_score + 5


def test_keys_and_nodes_by_plain_means():
    """Keys of texts shorter and longer than a context, and nodes that are summed from those below, against the bytes themselves."""
    import numpy as np

    from storyloom.llm.textblocks import BLOCK_ROWS, Block

    texts = [b"a", b"", b"ab cd", b"abcabcabc abcab", b"x y", b"the end of it"]
    data, begins, owner, _, _ = ctw.stream(Block(None, texts))
    want = [(c, b) for t in texts for c, b in pieces(t.split())]
    numbers = [int.from_bytes(bytes([*c, b]), "big") for c, b in want]
    every = ctw.byte_keys(data, begins, owner)
    assert every.tolist() == numbers
    assert int(every.max()).bit_length() + BLOCK_ROWS.bit_length() - 1 <= 64
    keys, counts = np.unique(every, return_counts=True)
    tree = ctw.Tree(keys, counts, 2)
    seen = Counter()
    for c, b in want:
        for d in range(2, ctw.DEPTH + 1):
            for j in range(8):
                seen[d, j, int.from_bytes(bytes(c[:d]), "big") << 8 | b >> (8 - j), b >> (7 - j) & 1] += 1
    for (d, j), (node, zeros, ones, _, _) in tree.nodes.items():
        for n, z, o in zip(node.tolist(), zeros.tolist(), ones.tolist()):
            assert (z, o) == (seen[d, j, n, 0], seen[d, j, n, 1])
        assert node.tolist() == sorted({k[2] for k in seen if k[:2] == (d, j)})


def test_answers_are_walked_in_pieces(monkeypatch):
    """Sums over the sorted keys, in pieces that cut runs of one key, are those of looking each key up."""
    import numpy as np

    rng = np.random.default_rng(5)
    every = rng.integers(0, 40, 500).astype(np.uint64) * np.uint64(0xFFFFFFFFFF) + np.uint64(7)
    owner = np.sort(rng.integers(0, 4096, 500)).astype(np.int32)
    keys = np.unique(every)
    logs = rng.normal(size=len(keys)).astype(np.float32)
    want = np.bincount(owner, weights=logs[np.searchsorted(keys, every)], minlength=4096)
    for piece in (1, 7, 1000):
        monkeypatch.setattr(ctw, "PIECE", piece)
        assert ctw._add_answers(every, owner, logs, 4096) == pytest.approx(want, abs=1e-9)
