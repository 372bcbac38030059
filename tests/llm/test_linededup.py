import random

from conftest import edge_rows, frame

from storyloom.llm import linededup as L


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(rows, least=24, most=2):
    place = {}
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                place.setdefault(line, (1 << 63 if i is None else i, n))
    lines = [x for x in place if len(x) >= least]
    near = {x for x in lines for y in lines if place[y] < place[x] and abs(len(x) - len(y)) <= most and edits(x, y) <= most}
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for n, x in enumerate(lines) if not x.strip(" ") or (place[x] == (1 << 63 if i is None else i, n) and x not in near)]
        out.append((str(i), None if t is None else "\n".join(kept), 0 if t is None else len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(df, **options):
    return sorted(((str(r.doc_id), r.text, r.lines, r.drops) for r in L.dedup_lines(df, names=("lines", "drops"), **options).collect()), key=str)


def test_edges(spark, edge, none):
    assert run(edge) == brute(edge_rows())
    assert L.dedup_lines(edge, names=("lines", "drops")).columns == [*edge.columns, "lines", "drops"]
    assert run(none) == []


def test_against_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdeé ", k=rng.randint(20, 60))) for _ in range(25)]

    def changed(line):
        line = list(line)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(line))
            line[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
        return "".join(line)

    rows = [(i, "\n".join(changed(rng.choice(base)) for _ in range(rng.randint(1, 6))), "s") for i in range(80)]
    rows += [(100 + i, base[0][:-1] + chr(97 + i) + "\n\nshort line\nshort linf", "s") for i in range(20)]
    assert run(frame(spark, rows).repartition(3)) == brute(rows)


def test_keys_of_segments(spark, monkeypatch):
    """Keys of every line by plain slices, and none of them written to disk."""
    lines = ["abcdefghijklmnopqrstuvwxyz", "é" * 24 + "abc", "x" * 31, "short line, but keyed too"]
    want = set()
    for line in lines:
        for less in range(3):
            n = len(line) - less
            sizes = [n // 3 + (i >= 3 - n % 3) for i in range(3)]
            for i in range(3):
                for move in range(max(-i, less - (2 - i)), min(i, less + 2 - i) + 1):
                    at = sum(sizes[:i]) + move
                    if 0 <= at and at + sizes[i] <= len(line):
                        want.add((line, i, n, line[at:at + sizes[i]], less == move == 0))
    df = spark.createDataFrame([(x, len(x)) for x in lines], "line string, size int")
    keys = spark.createDataFrame(sorted(want), "line string, i int, n int, part string, own boolean").selectExpr("line", "xxhash64(i, n, part) as key", "own")
    assert set(map(tuple, L._probes(df, 2, "line").collect())) == set(map(tuple, keys.collect()))
    saved, save = [], L.Workspace.save
    monkeypatch.setattr(L.Workspace, "save", lambda self, df, label: saved.append(label) or save(self, df, label))
    L.repeated_lines(frame(spark, [(i, x, "s") for i, x in enumerate(lines)])).collect()
    assert "live" in saved and "keyed" not in saved
