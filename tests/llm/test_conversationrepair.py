import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

from storyloom.llm import conversationrepair as C
from storyloom.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, gone boolean, fault string, n_rows int"
GOOD = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(C.SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """All edits at each row and in each state of the plain regular grammar, whole audits and texts kept."""
    step = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}

    def close(live):
        todo = sorted(live.items())
        while todo:
            state, (cost, audit, out) = todo.pop()
            for i, role in (("u", "user"), ("a", "assistant")):
                to = step.get((state, i))
                new = (cost + 2, audit + "I", out + [(role, "")])
                if to and (to not in live or new[:2] < live[to][:2]):
                    live[to] = new
                    todo.append((to, new))
        return live

    live = close({"0": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults(rows)):
        new = {}

        def offer(state, item):
            if state and (state not in new or item[:2] < new[state][:2]):
                new[state] = item

        late = fault == "truncated"
        for state, (cost, audit, out) in live.items():
            offer(state, (cost + 3, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                offer(step.get((state, role[:1])), (cost + late, audit + "K", out + [(role, text)]))
                for name in ("user", "assistant"):
                    offer(step.get((state, name[0])), (cost + 2 + late, audit + "R", out + [(name, text)]))
        live = close(new)
    return min(live[s] for s in ("0", "3") if s in live)


def exhaustive(rows, most):
    """Cheapest edits by trying all of them up to a cost."""
    marks, best = faults(rows), [None]

    def go(i, cost, audit, initials):
        if cost > most or (best[0] and cost > best[0][0]):
            return
        if i == len(rows) and GOOD.fullmatch(initials):
            best[0] = min(best[0] or (cost, audit), (cost, audit))
        for r in "ua":
            go(i, cost + 2, audit + "I", initials + r)
        if i < len(rows):
            late = marks[i] == "truncated"
            go(i + 1, cost + 3, audit + "D", initials)
            if marks[i] not in ("blank", "duplicate"):
                go(i + 1, cost + late, audit + "K", initials + rows[i][1][:1])
                for r in "ua":
                    go(i + 1, cost + 2 + late, audit + "R", initials + r)

    go(0, 0, "", "")
    return best[0]


def want(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    marks = faults(rows)
    turns = [t for t, *_ in rows if t is not None]
    cost, audit, out = cheapest(rows)
    return (len(rows), max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(marks.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
            sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def talk(rng, n):
    out = []
    for i in range(n):
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
        out.append((rng.choice([i, i, i, max(i - 1, 0), None]), role, rng.choice(["A.", "B!", "C?", "", " \t", "cut", f"t{i}.", f"t{i}", "é。"])))
    return out


def frame(spark, talks):
    rows = [(c, t, r, x, False, "f", 1) for c, talk in talks.items() for t, r, x in talk]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def test_plain_version_is_the_cheapest():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 3, 4):
        for _ in range(12):
            rows = [(i, rng.choice(["user", "assistant", "system"]), x) for i, (_, _, x) in enumerate(talk(rng, n))]
            assert exhaustive(rows, cheapest(rows)[0]) == cheapest(rows)[:2]


def test_against_plain_version(spark):
    rng = random.Random(9)
    talks = {i: talk(rng, rng.randint(1, 14)) for i in range(250)}
    talks[None], talks[-1] = talk(rng, 9), talk(rng, 1500)
    rows = frame(spark, talks).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = C.repair(rows)
        got = {r[0]: tuple(r)[1:] for r in found.collect()}
        fixed = defaultdict(list)
        for r in C.repaired_rows(rows, found).collect():
            fixed[r.conv_id].append(r)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {c: want(t) for c, t in talks.items()}
    for c in talks:
        out = sorted(fixed[c], key=lambda r: r.place)
        assert GOOD.fullmatch("".join(r.role[:1] for r in out))
        assert sha256("\n".join(f"{r.role}:{r.text}" for r in out).encode()).hexdigest() == got[c][-1]
        assert "".join(r.edit for r in out) == got[c][-2].replace("D", "")


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair(empty).count() == 0 and C.repaired_rows(empty, C.repair(empty)).count() == 0
    rows = spark.createDataFrame([(1, None, None, None, True, "f", 1), (2, None, None, None, False, "f", 1), (3, 5, "user", "Hi.", False, "f", 1)] +
                                 [(4, 1, "user", "Same.", False, "f", 1)] * 3, SCHEMA)
    got = {r.conv_id: tuple(r)[1:9] for r in C.repair(rows, gone="gone").collect()}
    assert got == {1: (0, 0, 0, 0, 0, 0, 0, ""), 2: (1, 0, 1, 0, 0, 0, 3, "D"), 3: (1, 0, 0, 0, 0, 0, 2, "KI"), 4: (3, 0, 0, 2, 0, 2, 8, "KDDI")}


def test_query_against_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    talks = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        code = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        rows = talks[r.conv_id]
        text = "" if code == 1 else re.sub("[.!?]", "", r.text) if code == 2 else r.text
        rows += [(r.turn, "user" if code == 4 else r.role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op12_conversation_repair"](spark, folder).collect()}
    assert got == {c: want(t) for c, t in talks.items()}
    assert sum(x[6] > 0 for x in got.values()) > 10
