"""Repair of conversation structure by the cheapest edits.

A repaired conversation has the roles ``(system? (user assistant)+)?``, told by their initials. Edits
of a row are Keep (0), Rerole to user or assistant (2) and Delete (3; the only one for blank and
repeated rows); Insert (2) puts an empty user or assistant turn anywhere. A kept or reroled row that breaks off
costs 1 more. Of the cheapest edits those whose initials come first in ASCII order are taken.

The search is a Viterbi pass over a conversation's rows with four states: nothing yet, after the system turn, after a user turn,
after an assistant turn. Each state's survivor is a leaf of a tree of backpointers. References are counted, so
branches without a survivor go at once, and as soon as a level of the tree has one node, all survivors
share it and its edits are final. Survivors that no future can make cheapest are dropped. Ties are decided over the whole unresolved
suffixes without walking them: survivors are ranked by their edit strings, and a new string is an old one's rank and some letters.
The pass has no texts, only row numbers, so an unresolved row costs a few bytes.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papershed.llm.common import stored

WHITE = " \t\n\x0b\x0c\r"
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The states that each state's next turn may lead to, by the turn's initial.
NEXT = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (EMPTY, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 2, 3, 2, 1
#: What a future costs more at most when it starts from the state of the row instead of that of the column:
#: turns are inserted before it, or its system turn is deleted.
EXCESS = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))


def _after_inserts(state: int) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """A state and the states that up to two inserted turns make of it, with the edits."""
    edits: list[tuple[str, str]] = []
    for _ in range(3):
        yield state, list(edits)
        initial = next(i for i in NEXT[state] if i in ROLES)
        state = NEXT[state][initial]
        edits.append(("I", ROLES[initial]))


def _moves(initial: str, fault: str | None) -> list[tuple[int, int, int, str, list[tuple[str, str | None]]]]:
    """Of a row's moves from state to state the best: (from, to, cost, letters, edits). An edit is a letter and a new role."""
    best: dict[tuple[int, int], tuple] = {}
    for state in range(4):
        for at, inserted in _after_inserts(state):
            before, broken = INSERT * len(inserted), BROKEN * (fault == "truncated")
            options: list[tuple[int, int, tuple[str, str | None]]] = [(at, DELETE, ("D", None))]
            if fault not in ("blank", "duplicate"):
                options += [(to, KEEP + broken, ("K", None)) for i, to in NEXT[at].items() if i == initial]
                options += [(to, REROLE + broken, ("R", ROLES[i])) for i, to in NEXT[at].items() if i in ROLES]
            for to, cost, edit in options:
                edits = [*inserted, edit]
                move = (before + cost, "".join(e for e, _ in edits), edits)
                best[state, to] = min(best.get((state, to), move), move, key=lambda m: m[:2])
    return [(*pair, *move) for pair, move in sorted(best.items())]


#: Moves by kind of row; a node of the tree names its move by number.
KINDS = [(i, f) for i in ("s", "u", "a", "") for f in (None, "truncated", "blank")]
MOVES = {kind: _moves(*kind) for kind in KINDS}
EDITS: list[list[tuple[str, str | None]]] = [m[4] for kind in KINDS for m in MOVES[kind]]
NUMBERED = {kind: [(*m[:4], sum(len(MOVES[k]) for k in KINDS[:at]) + n) for n, m in enumerate(MOVES[kind])] for at, kind in enumerate(KINDS)}


class Survivors:
    """The tree of one conversation. ``feed`` and ``finish`` return edits that are final: (row, letter, new role), row None for an insert."""

    def __init__(self) -> None:
        self.now = {EMPTY: (0, 0, -1)}  # state: cost, rank of its edit string, node
        self.parent: dict[int, int] = {}
        self.refs: dict[int, int] = {}
        self.move: dict[int, int] = {}
        self.level: dict[int, int] = {}
        self.levels: deque[set[int]] = deque()
        self.rows: deque = deque()  # of the unresolved levels
        self.done = self.nodes = 0

    def _release(self, node: int) -> None:
        while node in self.refs:
            self.refs[node] -= 1
            if self.refs[node]:
                return
            self.levels[self.level.pop(node) - self.done].discard(node)
            del self.refs[node], self.move[node]
            node = self.parent.pop(node)

    def _final(self) -> list[tuple[object, str, str | None]]:
        found = []
        while self.levels and len(self.levels[0]) == 1:
            (node,) = self.levels.popleft()
            row = self.rows.popleft()
            found += [(None if letter == "I" else row, letter, role) for letter, role in EDITS[self.move.pop(node)]]
            del self.refs[node], self.parent[node], self.level[node]
            self.done += 1
        return found

    def feed(self, row: object, initial: str, fault: str | None) -> list[tuple[object, str, str | None]]:
        kind = (initial if initial in ("s", "u", "a") else "", "blank" if fault == "duplicate" else fault)
        best: dict[int, tuple] = {}
        for state, to, cost, letters, move in NUMBERED[kind]:
            if state in self.now:
                was, rank, node = self.now[state]
                new = (was + cost, rank, letters, move, node)
                if to not in best or new[:3] < best[to][:3]:
                    best[to] = new
        best = {p: b for p, b in best.items() if all(c[0] + EXCESS[t][p] >= b[0] for t, c in best.items())}
        order = {key: k for k, key in enumerate(sorted({b[1:3] for b in best.values()}))}
        before, self.now = self.now, {}
        self.levels.append(set())
        self.rows.append(row)
        level = self.done + len(self.levels) - 1
        for state, (cost, rank, letters, move, node) in best.items():
            self.nodes += 1
            self.parent[self.nodes], self.refs[self.nodes], self.move[self.nodes], self.level[self.nodes] = node, 1, move, level
            if node in self.refs:
                self.refs[node] += 1
            self.levels[-1].add(self.nodes)
            self.now[state] = (cost, order[rank, letters], self.nodes)
        for _, _, node in before.values():
            self._release(node)
        return self._final()

    def finish(self) -> list[tuple[object, str, str | None]]:
        ends = [((cost + INSERT * len(edits), rank, "I" * len(edits)), state, edits) for state, (cost, rank, _) in self.now.items() for at, edits in _after_inserts(state) if at in ENDS]
        _, winner, edits = min(ends, key=lambda e: e[0])
        for state, (_, _, node) in self.now.items():
            if state != winner:
                self._release(node)
        return self._final() + [(None, *e) for e in edits]


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, order, row, fault`` of ``rows`` (with ``row``, a number of its own for each): the first fault that holds.

    blank: nothing but white space; duplicate: role and text stood earlier; truncated: the last character isn't ``.``, ``!`` or ``?``.
    First places are least values, summed up before they are shuffled, so no group of equal turns is gathered.
    """
    bare = F.btrim("text", F.lit(WHITE))
    slim = rows.select(
        "conv_id", "turn", "role", F.md5("text").alias("order"), "row", (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("broken"),
    )
    firsts = slim.groupBy(F.col("conv_id").alias("its_conv"), F.col("role").alias("its_role"), F.col("order").alias("its_order"))
    firsts = firsts.agg(F.min(F.struct("turn", "row"))["row"].alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("its_conv")) & (F.col("role") == F.col("its_role")) & (F.col("order") == F.col("its_order"))
    fault = F.when(F.col("blank"), "blank").when(F.col("row") != F.col("first"), "duplicate").when(F.col("broken"), "truncated")
    return slim.join(firsts, same).select("conv_id", "turn", "role", "order", "row", fault.alias("fault"))


def edits(rows: DataFrame) -> DataFrame:
    """The edits of every conversation in order: ``conv_id, step, edit, row, turn, new_role, fault, illegal``.

    ``edit`` is K, R, D or I; ``row`` and ``turn`` are null for an insert. ``illegal`` says that a row's
    role and that of the row before it are no system-user, user-assistant or assistant-user. A conversation's slim rows pass through
    one task in order, since each edit may hang on all before it; they are sorted on disk, not gathered.
    """
    conv_type = rows.schema["conv_id"].dataType.simpleString()

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "step", "edit", "row", "turn", "new_role", "fault", "illegal"]
        out: list[tuple] = []
        tree, now, step, last = None, None, 0, ""

        def take(final: list) -> None:
            nonlocal step
            for row, letter, role in final:
                row_id, turn, fault, illegal = row or (None, None, None, False)
                out.append((now, step, letter, row_id, turn, role, fault, illegal))
                step += 1

        def batch_of(types: list[pa.DataType]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        types: list[pa.DataType] = []
        for batch in batches:
            types = types or [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            for conv, turn, role, row_id, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "row", "fault"))):
                if tree is None or conv != now:
                    if tree is not None:
                        take(tree.finish())
                    tree, now, step, last = Survivors(), conv, 0, None
                initial = role[:1]
                illegal = last is not None and last + initial not in ("su", "ua", "au")
                last = initial
                take(tree.feed((row_id, turn, fault, illegal), initial, fault))
            yield batch_of(types)
        if tree is not None:
            take(tree.finish())
            yield batch_of(types)

    dealt = faults(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "order", "row").drop("order")
    return dealt.mapInArrow(repair, f"conv_id {conv_type}, step long, edit string, row long, turn long, new_role string, fault string, illegal boolean")


def repaired(turns: DataFrame) -> DataFrame:
    """Every edit with its text: ``conv_id, step, edit, role, text, turn, fault, illegal``; rows without D are the repaired conversation.

    ``turns`` needs ``conv_id, turn, role, text``, other columns are ignored. Rows are taken by turn (null first), then by role and a digest
    of the text; repeated rows stay rows of their own (and are duplicates). A null role or text counts as one space, rows with a null
    conv_id are one conversation, texts may have any length, and no rows give no edits. Roles and texts of deleted rows are those that went.
    """
    some = F.lit(" ")
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", some).alias("role"),
        F.coalesce("text", some).alias("text"), F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(rows)
    found = edits(rows).join(rows.select("row", "role", "text"), "row", "left")
    role, text = F.coalesce("new_role", "role"), F.coalesce("text", F.lit(""))
    return found.select("conv_id", "step", "edit", role.alias("role"), text.alias("text"), "turn", "fault", "illegal")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digests(edited: DataFrame) -> DataFrame:
    """Counts, cost, edit letters and a digest of the repaired ``role:text`` lines for each conversation, in one pass over sorted edits."""
    conv_type = edited.schema["conv_id"].dataType.simpleString()
    costs = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
        out: list[tuple] = []
        begun, now, types = False, None, []
        counts: dict[str, int] = {}
        audit, digest, least, most, distinct = bytearray(), hashlib.sha256(), None, None, 0

        def finish() -> None:
            counts["gaps"] = most - least + 1 - distinct if distinct else 0
            out.append((now, *(counts[c] for c in COUNTS), audit.decode(), digest.hexdigest()))

        for batch in batches:
            types = types or [batch.schema.field("conv_id").type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            for conv, edit, role, text, turn, fault, illegal in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text", "turn", "fault", "illegal"))):
                if not begun or conv != now:
                    if begun:
                        finish()
                    begun, now, counts = True, conv, dict.fromkeys(COUNTS, 0)
                    audit, digest, least, most, distinct, empty = bytearray(), hashlib.sha256(), None, None, 0, True
                audit += edit.encode()
                counts["cost"] += costs[edit] + (BROKEN if fault == "truncated" and edit != "D" else 0)
                counts["illegal"] += illegal
                if fault:
                    counts[fault] += 1
                if turn is not None and turn != most:
                    least, most, distinct = turn if least is None else least, turn, distinct + 1
                if edit != "D":
                    digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(names), types)], names)
            out.clear()
        if begun:
            finish()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    dealt = edited.repartition("conv_id").sortWithinPartitions("conv_id", "step")
    longs = ", ".join(f"{c} long" for c in COUNTS)
    return dealt.mapInArrow(read, f"conv_id {conv_type}, {longs}, audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults planted by a checksum of conv_id and turn: some dropped, emptied, broken off, repeated or given to the user."""
    some = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), some), F.lit(":"), F.coalesce(F.col("turn").cast("string"), some))
    rows = turns.select("conv_id", "turn", F.coalesce("role", some).alias("role"), F.coalesce("text", some).alias("text"), (F.crc32(key) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def damaged_and_repaired(turns: DataFrame) -> DataFrame:
    """The digests of every conversation of ``turns`` after damage and repair; zeros and empty ones where no row was left."""
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    found = digests(repaired(damaged(turns)))
    rows = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    nothing = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return rows.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), nothing)
