"""Repair of conversation structure: a generalised LR parser of roles that may delete, rerole and insert rows."""

from __future__ import annotations

from functools import cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: LR automaton of  C -> empty | P | s P,  P -> u a | P u a  over the initials of system, user and assistant.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
#: States that reduce at once, to P, with the number of symbols on the right-hand side; where P leads to; final states.
REDUCE, GOTO, FINAL = {5: 2, 7: 3}, {0: 3, 1: 4}, (0, 3, 4)
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\f\r"

_OUT = ("conv_id {0}, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
        "audit string, repaired_sha256 string")


@cache
def advance(stack: tuple, initial: str):
    """The stack after one symbol, reduced; None where the grammar has no such move."""
    top = SHIFT.get((stack[-1], initial))
    if top is None:
        return None
    stack += (top,)
    while stack[-1] in REDUCE:
        stack = stack[: -REDUCE[stack[-1]]]
        stack += (GOTO[stack[-1]],)
    return stack


def _before(a, b) -> bool:
    """Whether the edits on the path to a sort before those to b. Paths are linked (previous, letter, depth) and are only
    followed back to where they part."""
    x = y = ""
    while a is not b:
        if b is None or (a is not None and a[2] >= b[2]):
            x, a = a[1], a[0]
        else:
            y, b = b[1], b[0]
    return x < y


class Parser:
    """The graph-structured stack of one conversation, fed row by row.

    Of all edits that lead to the same stack top only the cheapest stays, with ties to the least audit: tops that are equal
    accept the same continuations, and two paths of equal cost to one place never are prefixes of each other. So at most
    six stacks live at a time. Each carries a running digest of its repaired rows in place of their texts.
    """

    def __init__(self):
        self.live = {0: (0, None, (0,), None)}
        self._insert()

    def _offer(self, new: dict, cost: int, path, letter: str, stack, digest, piece) -> None:
        path = (path, letter, 1 if path is None else path[2] + 1)
        old = new.get(stack[-1])
        if old is None or cost < old[0] or (cost == old[0] and _before(path, old[1])):
            new[stack[-1]] = (cost, path, stack, digest, piece)

    @staticmethod
    def _settled(cost, path, stack, digest, piece):
        if piece is None:
            return cost, path, stack, digest
        if digest is None:
            return cost, path, stack, sha256(piece)
        digest = digest.copy()
        digest.update(b"\n" + piece)
        return cost, path, stack, digest

    def _insert(self) -> None:
        """Adds what inserted rows reach, cheapest stacks first."""
        todo = sorted(self.live.values(), key=lambda x: x[0])
        while todo:
            cost, path, stack, digest = todo.pop(0)
            if self.live[stack[-1]][1] is not path:
                continue
            for initial, role in ROLES.items():
                to = advance(stack, initial)
                if to is not None:
                    new: dict = {}
                    self._offer(new, cost + COST["I"], path, "I", to, digest, f"{role}:".encode())
                    (made,) = new.values()
                    old = self.live.get(to[-1])
                    if old is None or made[0] < old[0] or (made[0] == old[0] and _before(made[1], old[1])):
                        self.live[to[-1]] = made = self._settled(*made)
                        todo.append(made)
                        todo.sort(key=lambda x: x[0])

    def feed(self, role: str, text: str, deletable_only: bool, truncated: bool) -> None:
        new: dict = {}
        late = 1 if truncated else 0
        for cost, path, stack, digest in self.live.values():
            self._offer(new, cost + COST["D"], path, "D", stack, digest, None)
            if deletable_only:
                continue
            to = advance(stack, role[:1])
            if to is not None:
                self._offer(new, cost + late, path, "K", to, digest, f"{role}:{text}".encode())
            for initial, name in ROLES.items():
                to = advance(stack, initial)
                if to is not None:
                    self._offer(new, cost + COST["R"] + late, path, "R", to, digest, f"{name}:{text}".encode())
        self.live = {top: self._settled(*x) for top, x in new.items()}
        self._insert()

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest repair."""
        best = None
        for top in FINAL:
            x = self.live.get(top)
            if x is not None and (best is None or x[0] < best[0] or (x[0] == best[0] and _before(x[1], best[1]))):
                best = x
        letters, path = [], best[1]
        while path is not None:
            letters.append(path[1])
            path = path[0]
        return best[0], "".join(reversed(letters)), (best[3] or sha256()).hexdigest()


def marked(rows: DataFrame, gone: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, gone, fault of every row, all rows of a conversation in one partition.

    fault is the first of blank, duplicate (role and text of an earlier row) and truncated (does not end in ., ! or ?),
    or null. Nulls in role and text are one space. Order is turn, nulls first, then role, then text. One exchange by
    conversation serves the window as well, which orders by digests and spills where a conversation is long.
    """
    space = F.lit(" ")
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"),
                      F.coalesce(F.col("role").cast("string"), space).alias("role"),
                      F.coalesce(F.col("text").cast("string"), space).alias("text"),
                      F.col(gone).alias("gone") if gone else F.lit(False).alias("gone"))
    out = out.withColumn("_key", F.when(~F.col("gone"), F.sha2(F.concat_ws("\n", F.octet_length("role").cast("string"), "role", "text"), 256)))
    out = out.repartition("conv_id")
    seen = Window.partitionBy("conv_id", "_key").orderBy(F.asc_nulls_first("turn"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(F.octet_length(bare) == 0, "blank").when(F.row_number().over(seen) > 1, "duplicate") \
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    return out.withColumn("fault", F.when(~F.col("gone"), fault)).drop("_key")


def _ordered(rows: DataFrame, *first) -> DataFrame:
    """Rows of a partition by conversation and place; of equal rows the one that is no repeat comes first."""
    return rows.sortWithinPartitions(F.asc_nulls_first("conv_id"), *first, F.asc_nulls_first("turn"), "role", "text",
                                     F.coalesce(F.col("fault") == "duplicate", F.lit(False)))


class _Summary:
    """What is counted of one conversation while its rows pass."""

    def __init__(self):
        self.n = self.gaps = self.illegal = self.turns = 0
        self.first = self.last = self.initial = None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.parser = Parser()

    def add(self, turn, role, text, fault) -> None:
        self.n += 1
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if fault is not None:
            self.faults[fault] += 1
        self.parser.feed(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.n, gaps, *self.faults.values(), self.illegal, *self.parser.result())


def repair(rows: DataFrame, gone: str | None = None) -> DataFrame:
    """One row per conv_id: n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The rows of a conversation, by turn (nulls first), then role and text, are kept (0), reroled to user or assistant (2),
    deleted (3) or joined by inserted empty rows (2) until their role initials read ``(s?(ua)+)?``; blank rows and repeats
    must go, truncated rows that stay cost 1 more. audit has the initials of the cheapest edits, ties to the least string;
    repaired_sha256 is the digest of the repaired ``role:text``, joined by newlines. gaps counts missing turn numbers.

    A null conv_id is a conversation of its own; nulls in role and text are one space; rows that are equal in all columns
    are repeats of the first. ``gone`` may name a boolean column: such rows only make sure that their conversation is in
    the result, with zeros and an empty audit where nothing else is. Rows stream through the parser, sorted by Spark, so
    memory is bounded by one row and the audit, however long a conversation is; only its digest, which is sequential by
    nature, keeps it in one task. An empty table gives an empty result; extra columns are not read.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def parse(batches):
        key, now, started = None, None, False
        done: list[tuple] = []

        def batch():
            columns = list(zip(*done))
            out = pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kinds), *[pa.array(c, pa.int64()) for c in columns[1:8]],
                 *[pa.array(c, pa.string()) for c in columns[8:]]],
                names=["conv_id", "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])
            done.clear()
            return out

        kinds = pa.null()
        for rows in batches:
            kinds = rows.schema.field("conv_id").type
            for conv, turn, role, text, out, fault in zip(*(rows.column(c).to_pylist() for c in
                                                            ("conv_id", "turn", "role", "text", "gone", "fault"))):
                if not started or conv != key:
                    if started:
                        done.append((key, *now.row()))
                    key, now, started = conv, _Summary(), True
                if not out:
                    now.add(turn, role, text, fault)
            if len(done) >= 1024:
                yield batch()
        if started:
            done.append((key, *now.row()))
            yield batch()

    return _ordered(marked(rows, gone)).mapInArrow(parse, _OUT.format(kind))


def repaired_rows(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turn, role, text, edit of the repaired conversations, from repair()'s audits.

    Inserted rows have no turn and an empty text. The audit reaches the rows as one more row in front of them.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    body = marked(rows).select("conv_id", "turn", "role", "text", "fault", F.lit(None).cast("string").alias("audit"))
    head = repairs.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"),
                          F.lit(None).cast("string").alias("fault"), "audit")
    both = _ordered(body.unionByName(head).repartition("conv_id"), F.col("audit").isNull())

    def apply(batches):
        audit, i, stack, place = "", 0, (0,), 0
        for batch in batches:
            out: list[tuple] = []

            def emit(conv, turn, role, text, letter):
                nonlocal stack, place
                stack = advance(stack, role[:1])
                out.append((conv, place, turn, role, text, letter))
                place += 1

            def wanted():
                return "assistant" if advance(stack, "a") else "user"

            def inserts(conv):
                nonlocal i
                while audit[i : i + 1] == "I":
                    emit(conv, None, wanted(), "", "I")
                    i += 1

            for conv, turn, role, text, heading in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "audit"))):
                if heading is not None:
                    audit, i, stack, place = heading, 0, (0,), 0
                    inserts(conv)
                    continue
                letter = audit[i]
                i += 1
                if letter != "D":
                    emit(conv, turn, wanted() if letter == "R" else role, text, letter)
                inserts(conv)
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))],
                names=["conv_id", "place", "turn", "role", "text", "edit"])

    return both.mapInArrow(apply, f"conv_id {kind}, place long, turn long, role string, text string, edit string")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows damaged by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space).

    0 marks a row as gone, 1 empties its text, 2 takes ., ! and ? out of it, 3 repeats it, 4 makes it a user's.
    """
    space = F.lit(" ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), space)
    code = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return rows.select(
        "conv_id", "turn",
        F.when(code == 4, "user").otherwise(text("role")).alias("role"),
        F.when(code.isin(0, 1), "").when(code == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        (code == 0).alias("gone"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")
