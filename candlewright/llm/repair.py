"""Repair of conversations whose roles do not follow `(system? (user assistant)+)?`, by generalised LR parsing with edits.

The role grammar is compiled into an SLR table. Rows are fed to a graph-structured stack: stacks are
linked nodes that share their tails, and before every row each top may be moved on by inserted empty
turns; the row itself is then kept (shifted as it is), given another role (shifted as that) or
deleted. Stacks whose tops are in the same state merge, and the one of lower (cost, audit) stays: what
may follow a top depends on its state alone in this grammar, so the other can never become better.
An audit is the string of edits, D(elete), I(nsert), K(eep), R(erole); its ASCII order breaks ties.

Two audits that both end in a row's edit and cover the same rows are equal or differ before either
ends. So tops carry the rank of their audit instead of the string, and the new ranks follow from the
old ones and the new letters. A step is therefore a function of few numbers (states, costs above the
lowest, ranks, and the kind of row) and is worked out once per worker for each case that occurs. Costs
more than SLACK above the lowest are dropped; from any top, any other's future costs at most that more.

One task streams a conversation's rows in order of turn and holds four tops, a digest for each, and eight
bytes a row for the audit; texts are never gathered. A conversation is not split: its result is one
SHA-256 over its whole text in order, and that function has no parts that could be joined. Sorting,
repeated texts and faults are ordinary sorts and windows that spill.

Cases: null roles and texts count as one space, null turns come first, null ids are a conversation of
their own. Rows of equal turn are taken in order of role and text; repeated rows are duplicates. A role
is read by its first character; an empty one starts no legal pair. Empty and blank texts are deleted.
A conversation without rows gives zeros and empty strings; an empty table gives an empty result.
Input columns other than the four named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: White space that parts words, and a character that is none of it.
WORD_SPACES = " \t\n\x0b\x0c\r"
WORD_CHARACTER = r"[^\x20\x09-\x0D]"

GRAMMAR = (("talk", ()), ("talk", ("turns",)), ("talk", ("s", "turns")), ("turns", ("turn",)), ("turns", ("turns", "turn")), ("turn", ("u", "a")))
END = "$"
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: The dearest move between tops: two inserted turns, or one and the deletion of a first row that the other would have kept.
SLACK = max(2 * INSERT, INSERT + DELETE)
#: First fault of a row.
SOUND, BLANK, DUPLICATE, CUT, DROPPED = 0, 1, 2, 3, 4
Stack = tuple  # (state, stack below) or ()


@cache
def _tables() -> tuple[dict, dict]:
    """SLR tables of GRAMMAR: actions[state, terminal] as a list of ('shift', state), ('reduce', production) or ('accept', 0), and gotos."""
    rules = (("start", ("talk",)), *GRAMMAR)
    names = {left for left, _ in rules}
    empty = {left for left, right in rules if not right}
    first, follow = {n: set() for n in names}, {n: set() for n in names}
    follow["start"].add(END)
    for _ in range(len(rules) ** 2):
        for left, right in rules:
            for x in right:
                first[left] |= first[x] if x in names else {x}
                if x not in empty:
                    break
            after = set(follow[left])
            for x in reversed(right):
                if x in names:
                    follow[x] |= after
                    after = first[x] | (after if x in empty else set())
                else:
                    after = {x}

    def closed(items: set) -> frozenset:
        todo = list(items)
        while todo:
            rule, dot = todo.pop()
            wanted = rules[rule][1][dot : dot + 1]
            for i, (left, _) in enumerate(rules):
                if (left,) == wanted and (i, 0) not in items:
                    items.add((i, 0))
                    todo.append((i, 0))
        return frozenset(items)

    states = [closed({(0, 0)})]
    actions: dict = {}
    gotos: dict = {}
    for here, items in enumerate(states):  # grows meanwhile
        for symbol in sorted({rules[r][1][d] for r, d in items if d < len(rules[r][1])}):
            there = closed({(r, d + 1) for r, d in items if rules[r][1][d : d + 1] == (symbol,)})
            if there not in states:
                states.append(there)
            if symbol in names:
                gotos[here, symbol] = states.index(there)
            else:
                actions.setdefault((here, symbol), []).append(("shift", states.index(there)))
        for r, d in sorted(items):
            if d == len(rules[r][1]):
                for t in sorted(follow[rules[r][0]]):
                    actions.setdefault((here, t), []).append(("accept", 0) if r == 0 else ("reduce", r - 1))
    return actions, gotos


@cache
def advance(stack: Stack, terminal: str) -> tuple[Stack, ...]:
    """Every stack that reads terminal next; for END, the stack itself if the input may end there."""
    actions, gotos = _tables()
    out: list[Stack] = []
    for kind, to in actions.get((stack[0], terminal), ()):
        if kind == "accept":
            out.append(stack)
        elif kind == "shift":
            out.append((to, stack))
        else:
            left, right = GRAMMAR[to]
            below = stack
            for _ in right:
                below = below[1]
            out += advance((gotos[below[0], left], below), terminal)
    return tuple(out)


START: Stack = (0, ())


def _inserted(tops: tuple) -> dict[int, tuple]:
    """By state, the best (cost, rank, letters, roles put out, origin, stack) after any inserted turns."""
    best: dict[int, tuple] = {}
    todo = [(cost, rank, "", (), i, stack) for i, (stack, cost, rank) in enumerate(tops)]
    while todo:
        x = todo.pop()
        if x[5][0] in best and best[x[5][0]][:3] <= x[:3]:
            continue
        best[x[5][0]] = x
        for terminal, role in ROLES.items():
            todo += [(x[0] + INSERT, x[1], x[2] + "I", (*x[3], (role, False)), x[4], s) for s in advance(x[5], terminal)]
    return best


@cache
def step(tops: tuple, initial: str, fault: int) -> tuple[int, tuple, tuple]:
    """The tops after one row: lowest cost, tops as (stack, cost above it, rank of audit), and for each (origin, letters, put out).

    Put out are (role, with the row's text) pairs; a role of None is the row's own.
    """
    found: dict[int, tuple] = {}

    def offer(x: tuple, cost: int, letter: str, stack: Stack, put: tuple) -> None:
        new = (x[0] + cost, x[1], x[2] + letter, x[3] + put, x[4], stack)
        if stack[0] not in found or new[:3] < found[stack[0]][:3]:
            found[stack[0]] = new

    extra = TRUNCATED if fault == CUT else 0
    for x in _inserted(tops).values():
        offer(x, DELETE, "D", x[5], ())
        if fault not in (BLANK, DUPLICATE):
            for s in advance(x[5], initial) if initial in ("s", "u", "a") else ():
                offer(x, extra, "K", s, ((None, True),))
            for terminal, role in ROLES.items():
                for s in advance(x[5], terminal):
                    offer(x, REROLE + extra, "R", s, ((role, True),))
    low = min(x[0] for x in found.values())
    kept = sorted((x for x in found.values() if x[0] <= low + SLACK), key=lambda x: x[1:3])
    ranks: dict[tuple, int] = {}
    new = tuple((x[5], x[0] - low, ranks.setdefault(x[1:3], len(ranks))) for x in kept)
    return low, new, tuple((x[4], x[2], x[3]) for x in kept)


@cache
def finish(tops: tuple) -> tuple[int, tuple]:
    """Cost and (origin, letters, put out) of the best stack that may end."""
    best = min((x for x in _inserted(tops).values() if advance(x[5], END)), key=lambda x: x[:3])
    return best[0], (best[4], best[2], best[3])


class Repair:
    """One conversation, row by row."""

    def __init__(self) -> None:
        self.tops: tuple = ((START, 0, 0),)
        self.digests = [hashlib.sha256()]
        self.cost, self.trail = 0, []
        self.counts = [0] * 5
        self.illegal, self.before = 0, None
        self.turns, self.least, self.last = 0, None, None

    def _put(self, move: tuple, role: str, text: str):
        origin, _, put = move
        digest, started = self.digests[origin].copy(), self.tops[origin][0] != START
        for name, with_text in put:
            digest.update((("\n" if started else "") + (name or role) + ":" + (text if with_text else "")).encode())
            started = True
        return digest

    def row(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        self.counts[fault] += 1
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.last:
            self.turns += 1
            self.least, self.last = turn if self.least is None else self.least, turn
        low, tops, moves = step(self.tops, initial, fault)
        self.cost += low
        self.digests = [self._put(m, role, text) for m in moves]
        self.tops = tops
        self.trail.append(moves)

    def result(self) -> dict:
        low, move = finish(self.tops)
        digest = self._put(move, "", "")
        at, letters = move[0], [move[1]]
        for moves in reversed(self.trail):
            letters.append(moves[at][1])
            at = moves[at][0]
        gaps = 0 if self.last is None else self.last - self.least + 1 - self.turns
        return {
            "gaps": gaps, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE], "truncated": self.counts[CUT], "illegal": self.illegal,
            "cost": self.cost + low, "audit": "".join(reversed(letters)), "repaired_sha256": digest.hexdigest(),
        }


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(convs: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (id, turn, role, text, dropped) with the planted damage; a dropped row stays as a mark of its conversation."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = convs.select(F.col(id_col).alias("id"), F.col(turn).cast("long").alias("turn"), name(role).alias("role"), name(text).alias("text"),
                        (F.crc32(F.encode(F.concat(name(id_col), F.lit(":"), name(turn)), "utf-8")) % 20).alias("h"))
    changed = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select(
        "id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("h") > 0, changed).alias("text"), (F.col("h") == 0).alias("dropped"),
        F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with their first fault, a conversation's in order within one partition."""
    rows = rows.repartition("id")
    seen = F.row_number().over(Window.partitionBy("id", "role", "text", "dropped").orderBy(F.col("turn").asc_nulls_first()))
    last = F.right(F.rtrim(F.col("text"), F.lit(WORD_SPACES)), F.lit(1))
    fault = (
        F.when(F.col("dropped"), DROPPED).when(~F.col("text").rlike(WORD_CHARACTER), BLANK).when(F.col("seen") > 1, DUPLICATE)
        .when(~last.isin(".", "!", "?"), CUT).otherwise(SOUND)
    )
    rows = rows.withColumn("seen", seen).select("id", "turn", "role", "text", fault.alias("fault"))
    return rows.sortWithinPartitions("id", F.col("turn").asc_nulls_first(), "role", "text")


def _rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    return chain.from_iterable(zip(*(b.column(c).to_pylist() for c in columns), strict=True) for b in batches)


def report(rows: DataFrame) -> DataFrame:
    """Per conversation of rows (id, turn, role, text, dropped): id, the faults, and cost, audit and digest of the cheapest repair."""
    schema = StructType([StructField("id", rows.schema["id"].dataType), *_parse_datatype_string(REPORT)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for key, group in groupby(_rows(batches, ("id", "turn", "role", "text", "fault")), key=itemgetter(0)):
            one = Repair()
            for _, turn, role, text, fault in group:
                if fault != DROPPED:
                    one.row(turn, role, text, fault)
            out.append({"id": key, **one.result()})
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, arrow)

    return _ordered(rows).mapInArrow(run, schema)


def repaired_turns(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """The repaired conversations, a row per turn: id, place (from 0), edit (I, K or R), role, text.

    A conversation's audit reaches the stream before its rows, so that one string is held and no row carries it.
    """
    schema = StructType([StructField("id", rows.schema["id"].dataType), *_parse_datatype_string("place long, edit string, role string, text string")])
    arrow = to_arrow_schema(schema)

    def apply(group: Iterator[tuple]) -> Iterator[tuple[str, str, str]]:
        _, _, audit, _, _, _ = next(group)
        before = ""
        for edit in audit or "":
            if edit == "I":
                role, text = "user" if before in ("", "s", "a") else "assistant", ""
            else:
                _, _, _, role, text, _ = next(r for r in group if not r[5])
                if edit == "D":
                    continue
                role = role if edit == "K" else "user" if before in ("", "s", "a") else "assistant"
            before = role[:1]
            yield edit, role, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, group in groupby(_rows(batches, ("id", "mark", "audit", "role", "text", "dropped")), key=itemgetter(0)):
            for place, turn in enumerate(apply(group)):
                out.append((key, place, *turn))
                if len(out) == 4096:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in out], arrow)
                    out = []
        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in out], arrow)

    both = rows.withColumn("mark", F.lit(1)).unionByName(reports.select("id", "audit", F.lit(0).alias("mark")), allowMissingColumns=True)
    ordered = both.repartition("id").sortWithinPartitions("id", "mark", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(run, schema)
