"""Conversation structure repair: the cheapest edits that make a conversation's roles well formed.

A row can be kept (K, cost 0), given the role user or assistant (R, 3) or deleted (D, 4), and an empty user or
assistant turn can be inserted anywhere (I, 3).  Blank and duplicate rows must be deleted; a truncated row that stays adds
3.  The initials of the roles that are left must be of the form ``(s?(ua)+)?``.  Of equally cheap edits those whose
initials are least as a string win.

Decoding is a Viterbi search over the four states of that form (nothing yet, after s, after u, after a) as the rows
stream by.  Every state has one survivor, a leaf of a tree of backpointers; nodes count who refers to them, and are freed
with the last one.  As soon as all survivors share an ancestor, the edits above it are final: they are emitted and forgotten,
so a task holds the rows on which survivors still differ, not the conversation.  Ties are settled by comparing
the complete edits of both paths since their common ancestor.  (Two tied paths of one state have used up the same rows, so neither's edits
begin with all of the other's, and no later edit can turn the comparison.)  The states "nothing yet" and "after s" are given up as
soon as the one after a is better in every future, which lets survivors meet.

On Spark, rows are hash-partitioned by conversation and sorted within partitions, so a conversation of any length streams
through a task from spillable sorted files.  Whether a row is a duplicate is told by a marker that
stands before the first row of each (role, text): the markers come from an aggregation that is
combined before its shuffle, so no task remembers the texts of a conversation.

Defined results: a null role or text counts as one space; null turns come first; rows with equal turns stand in the order of role and a
hash of the text; a null ``conv_id`` is a conversation of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\v\f\r"
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEEDS = {EMPTY: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}  # the role that may come next


class Node:
    """An edit on a path: what was done, to which row, under which role, and how many refer to it."""

    __slots__ = ("parent", "edit", "role", "row", "refs", "depth", "kids")

    def __init__(self, parent: Node | None, edit: str, role: str | None, row: tuple | None):
        self.parent, self.edit, self.role, self.row = parent, edit, role, row
        self.refs, self.kids = 0, []
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.refs += 1
            parent.kids.append(self)


def release(node: Node | None) -> None:
    """Takes one reference away; nodes that nobody refers to are cut from the tree."""
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        above = node.parent
        if above is not None:
            above.kids.remove(node)
        node.parent, node = None, above


def suffixes(p: Node, q: Node) -> tuple[str, str]:
    """The edits of both paths since their common ancestor."""
    a, b = [], []
    while p is not q:
        if p.depth >= q.depth:
            a.append(p.edit)
            p = p.parent
        else:
            b.append(q.edit)
            q = q.parent
    return "".join(reversed(a)), "".join(reversed(b))


class Decoder:
    """Edits of one conversation, given to ``emit(edit, role, row)`` as soon as they are final."""

    def __init__(self, emit: Callable[[str, str | None, tuple | None], None]):
        self.emit = emit
        self.root = Node(None, "", None, None)
        self.root.refs = 1
        self.best: dict[int, tuple[int, Node]] = {EMPTY: (0, self.root)}
        self.pending = self.most = 0
        self._inserts()

    @staticmethod
    def _better(x: tuple[int, Node, str], y: tuple[int, Node, str]) -> bool:
        """Whether the option x (cost, path, further edit) goes before y."""
        if x[0] != y[0]:
            return x[0] < y[0]
        a, b = suffixes(x[1], y[1])
        return a + x[2] < b + y[2]

    def _inserts(self) -> None:
        """Also the states that one inserted turn, or two, leads to."""
        for to in (USER, ASSISTANT):
            now = self.best.get(to)
            top = (now[0], now[1], "") if now else None
            for at in (USER,) if to == ASSISTANT else (EMPTY, SYSTEM, ASSISTANT):
                if at in self.best:
                    cost, node = self.best[at]
                    x = (cost + INSERT, node, "I")
                    if top is None or self._better(x, top):
                        top = x
            if top and top[2]:
                new = Node(top[1], "I", NEEDS[USER] if to == ASSISTANT else "user", None)
                new.refs += 1
                self.best[to] = (top[0], new)
                if now:
                    release(now[1])

    def add(self, row: tuple, role: str, fault: str | None) -> None:
        """The next row: its role and its first fault."""
        options: dict[int, tuple] = {}

        def offer(to: int, cost: int, node: Node, edit: str, new_role: str | None) -> None:
            old = options.get(to)
            if old is None or self._better((cost, node, edit), old[:3]):
                options[to] = (cost, node, edit, new_role)

        for state, (cost, node) in self.best.items():
            offer(state, cost + DELETE, node, "D", None)
            if fault in ("blank", "duplicate"):
                continue
            more = TRUNCATED if fault == "truncated" else 0
            to = AFTER.get((state, role[:1]))
            if to is not None:
                offer(to, cost + KEEP + more, node, "K", role)
            needed = NEEDS[state]
            offer(AFTER[state, needed[0]], cost + REROLE + more, node, "R", needed)
        old = list(self.best.values())
        self.best = {}
        for state, (cost, node, edit, new_role) in options.items():
            new = Node(node, edit, new_role, row)
            new.refs += 1
            self.best[state] = (cost, new)
        for _, node in old:
            release(node)
        self._inserts()
        self._give_up()
        self.pending += 1
        self.most = max(self.most, self.pending)
        self._settle()

    def _give_up(self) -> None:
        """Drops survivors that the one after a beats whatever comes: it can go on with the same edits, or delete the system row
        that only the start allows."""
        if ASSISTANT in self.best:
            cost = self.best[ASSISTANT][0]
            for state, more in ((EMPTY, DELETE), (SYSTEM, 0)):
                if state in self.best and cost + more < self.best[state][0]:
                    release(self.best.pop(state)[1])

    def _settle(self) -> None:
        """Emits the edits that all survivors share."""
        while self.root.refs == 1 and self.root.kids:
            self.root = self.root.kids[0]
            self.root.parent = None
            self.pending -= self.root.row is not None
            self.emit(self.root.edit, self.root.role, self.root.row)
            self.root.row = None

    def finish(self) -> int:
        """Emits what is left and gives the cost."""
        ends = [(s, *self.best[s]) for s in (EMPTY, ASSISTANT) if s in self.best]
        won = ends[0]
        for x in ends[1:]:
            if self._better((x[1], x[2], ""), (won[1], won[2], "")):
                won = x
        for state, (_, node) in list(self.best.items()):
            if state != won[0]:
                release(node)
        self.best = {won[0]: won[1:]}
        self._settle()
        return won[1]


class Conversation:
    """Counts, edits and digest of one conversation, row by row."""

    def __init__(self, conv_id, keep_rows: bool):
        self.conv_id, self.rows, self.n = conv_id, [] if keep_rows else None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.initial = None
        self.audit, self.digest, self.written = bytearray(), hashlib.sha256(), False
        self.decoder = Decoder(self._emit)

    def _emit(self, edit: str, role: str | None, row: tuple | None) -> None:
        self.audit += edit.encode()
        turn, old, text = row or (None, None, "")
        if edit != "D":
            self.digest.update(("\n" * self.written + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.written = True
        if self.rows is not None:
            self.rows.append((self.conv_id, self.n, edit, turn, old, role, text))
            self.n += 1

    def add(self, turn, role: str, text: str, first: bool) -> None:
        body = text.rstrip(SPACE)
        fault = "blank" if not body else "duplicate" if not first else "truncated" if body[-1] not in ".!?" else None
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.decoder.add((turn, role, text), role, fault)

    def result(self) -> tuple:
        cost = self.decoder.finish()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, self.audit.decode(), self.digest.hexdigest(), self.decoder.most


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "most_pending")
EDITS = ("seq", "edit", "turn", "old_role", "role", "text")


def _stream(batches: Iterator[pa.RecordBatch], edits: bool, schema: pa.Schema, limit: int = 4096) -> Iterator[pa.RecordBatch]:
    """Conversations of a partition's sorted rows: reports, or edits as they become final."""
    current, marker, last, out = None, None, None, []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out.clear()
        return batch

    def close() -> None:
        if current is not None:
            report = current.result()
            out.extend(current.rows if edits else [report])

    for batch in batches:
        for conv, turn, role, text, d0, d1, body in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if current is None or conv != current.conv_id:
                close()
                current, marker, last = Conversation(conv, edits), None, None
            key = (turn, role, d0, d1)
            if not body:
                marker = key
                continue
            current.add(turn, role, text, marker == key and last != key)
            last = key
            if edits:
                out.extend(current.rows)
                current.rows.clear()
            if len(out) >= limit:
                yield flush()
    close()
    if out:
        yield flush()


def _flow(conversations: DataFrame) -> DataFrame:
    """All rows, sorted within conversations, with a marker before the first row of each (role, text)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", "turn", blank("role"), blank("text"))
    rows = rows.select("*", F.xxhash64("role", "text").alias("d0"), F.xxhash64(F.lit("second"), "text", "role").alias("d1"), F.lit(1).alias("body"))
    firsts = rows.groupBy("conv_id", "role", "d0", "d1").agg(F.min(F.struct("turn")).alias("at"))  # null is the least turn
    firsts = firsts.select("conv_id", "at.turn", "role", F.lit(None).cast("string").alias("text"), "d0", "d1", F.lit(0).alias("body"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "d0", "d1", "body"]
    return firsts.union(rows.select(firsts.columns)).repartition("conv_id").sortWithinPartitions(*order)


def _decoded(conversations: DataFrame, edits: bool, columns: list[tuple[str, str]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([conversations.schema["conv_id"]])
    for name, kind in columns:
        schema = schema.add(name, conversations.schema["turn"].dataType if kind == "turn" else kind)
    return _flow(conversations).mapInArrow(partial(_stream, edits=edits, schema=to_arrow_schema(schema)), schema)


def reports(conversations: DataFrame) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text): its faults, the cost, the initials of the edits in order (K, R, D,
    I), the SHA-256 of the repaired rows, and the most rows that were ever undecided."""
    return _decoded(conversations, False, [(n, "string" if n in ("audit", "repaired_sha256") else "long") for n in REPORT])


def edits(conversations: DataFrame) -> DataFrame:
    """One row for each edit, in the order ``seq`` of the conversation: what was done to which turn, the role before and after it, and the
    text.  Without those of edit D they are the repaired conversation."""
    kinds = {"seq": "long", "turn": "turn"}
    return _decoded(conversations, True, [(n, kinds.get(n, "string")) for n in EDITS])


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the repaired conversations, turns numbered from 0 without gaps."""
    from pyspark.sql import Window

    kept = edits(conversations).where("edit <> 'D'")
    return kept.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("seq")) - 1).cast("long").alias("turn"), "role", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with rows dropped, emptied, cut off, repeated or given to the user, by a hash of their place."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    fault = F.crc32(F.encode(place, "UTF-8")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(fault == 4, "user").otherwise(blank("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(fault == 3, 2).otherwise(1)))
    return conversations.where(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")
