"""Cheapest repair of conversations by a Viterbi pass whose survivors coalesce.

A conversation is well formed when its role initials read ``(s?(ua)+)?``. Its
rows, in order, are kept, given another role or deleted, and empty turns are
inserted between them, at the least total cost; of equally cheap repairs the
one whose edit initials (``D``, ``I``, ``K``, ``R``) come first as text wins.

One pass keeps, for each state (nothing yet, after s, after u, after a), the
best repair so far. The survivors are leaves of a tree of edits with parent
pointers and counts of children. Branches without a survivor are freed, and
whatever lies on the only branch at the root is decided: it is emitted and
forgotten. Only what survivors still disagree on is held, and equally cheap
candidates are told apart by the whole of their undecided edits.
Runs of deletions are one node with a count, and a state that can no longer
win (dearer than a later one could make up for) is given up.

Faults are found by Spark: blank and cut-off texts row by row, repeats by an
aggregate of first turns that combines before it shuffles, joined back only
for texts that occur twice. Then rows are sorted within conversations, by
turn, role and text, and one task streams each conversation in Arrow batches;
its digest needs that order anyway. What it keeps of a conversation is what is
undecided and one letter for each edit.

Defined results: null roles and texts read as one blank; null turns come
first; rows without a conversation id are one conversation; equal rows are
repeats of the first; a role without any letter fits nowhere; conversations
without rows have zeros and the hash of an empty text; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushgate.llm.common import sha256_hex

BLANKS = " \t\n\x0b\x0c\r"
KEEP, DELETE, INSERT, REROLE = "K", "D", "I", "R"
REROLE_COST, DELETE_COST, INSERT_COST, CUT_COST = 1, 2, 5, 5
SOUND, BLANK, REPEATED, CUT = range(4)

#: States: nothing yet, after s, after u, after a; and where each may go by a role's initial.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
ROLES = {"u": "user", "a": "assistant"}
#: The role that a new or changed turn gets, by state.
WANTED = ("u", "u", "a", "u")


class Node:
    """An edit, repeated ``count`` times if it is a deletion; ``children`` and survivors hold it."""

    __slots__ = ("parent", "edit", "count", "out", "holds")

    def __init__(self, parent: Node | None, edit: str, out: tuple[str, str] | None):
        self.parent, self.edit, self.out, self.count, self.holds = parent, edit, out, 1, 0
        if parent:
            parent.holds += 1


def _release(node: Node) -> None:
    """Take one hold off, and free the branch that nothing holds any more."""
    node.holds -= 1
    while not node.holds and node.parent:
        node, gone = node.parent, node
        gone.parent = None
        node.holds -= 1


class Repair:
    """Repairs one conversation, row by row, and hands decided edits to ``emit(edit, count, out)``.

    A survivor is ``(cost, (rank, edits), node)``: its place among the edits of all survivors
    as of the last row, and the insertions since. After a row all survivors end with an edit
    of that row, so none is the beginning of another: their order is settled by their first
    difference, however far back, and whatever follows cannot change it. Ranks carry that
    comparison of whole undecided edits along, so that no tie walks the tree again.
    """

    def __init__(self, emit: Callable[[str, int, tuple[str, str] | None], None]):
        self.emit = emit
        self.root = Node(None, "", None)
        self.root.holds = 1
        self.best: list[tuple[int, tuple[int, str], Node] | None] = [(0, (0, ""), self.root), None, None, None]
        self._insert()

    def add(self, role: str, text: str, fault: int) -> None:
        """One more row."""
        found: list[tuple | None] = [None] * 4

        def offer(state: int, cost: int, edit: str, out: tuple | None) -> None:
            old, key = found[state], (cost, (rank, edits + edit))
            if old is None or key < old[0]:
                found[state] = (key, node, edit, out)

        extra = CUT_COST if fault == CUT else 0
        for state, survivor in enumerate(self.best):
            if survivor is None:
                continue
            cost, (rank, edits), node = survivor
            offer(state, cost + DELETE_COST, DELETE, None)
            if fault in (SOUND, CUT):
                if role[:1] in NEXT[state]:
                    offer(NEXT[state][role[:1]], cost + extra, KEEP, (role, text))
                new = WANTED[state]
                offer(NEXT[state][new], cost + REROLE_COST + extra, REROLE, (ROLES[new], text))
        self._take(found)
        self._insert()
        self._give_up()
        self._settle()

    def _take(self, found: list) -> None:
        """Make the candidates the survivors; a run of deletions grows in place where nothing else holds it."""
        sources = [f[1] for f in found if f]
        ranks = {k: i for i, k in enumerate(sorted(f[0][1] for f in found if f))}
        old, self.best = self.best, [None] * 4
        for state, f in enumerate(found):
            if f is None:
                continue
            (cost, place), node, edit, out = f
            if edit == DELETE == node.edit and node.holds == 1 and sources.count(node) == 1:
                node.count += 1
            else:
                node = Node(node, edit, out)
            node.holds += 1
            self.best[state] = (cost, (ranks[place], ""), node)
        for survivor in old:
            if survivor:
                _release(survivor[2])

    def _insert(self) -> None:
        """Insert empty turns after the row where that is cheaper, or as cheap and earlier; two in a row at most help."""
        for state in (START, AFTER_S, AFTER_A, AFTER_U):
            if (here := self.best[state]) is None:
                continue
            cost, (rank, edits), node = here
            new = WANTED[state]
            there, key = self.best[NEXT[state][new]], (cost + INSERT_COST, (rank, edits + INSERT))
            if there is None or key < there[:2]:
                child = Node(node, INSERT, (ROLES[new], ""))
                child.holds += 1
                self.best[NEXT[state][new]] = (*key, child)
                if there:
                    _release(there[2])

    def _give_up(self) -> None:
        """Whatever may follow the start or an s may follow an a, at the price of deleting one s."""
        if done := self.best[AFTER_A]:
            for state, ahead in ((START, DELETE_COST), (AFTER_S, 0)):
                if (here := self.best[state]) and here[0] > done[0] + ahead:
                    _release(here[2])
                    self.best[state] = None

    def _settle(self) -> None:
        """Emit the edits that all survivors share."""
        leaves = [s[2] for s in self.best if s]
        if self.root.holds > 1 or self.root in leaves:
            return
        # The only child of the root lies on the way up from any survivor.
        way = self._way(leaves[0])
        while self.root.holds == 1 and self.root not in leaves:
            self.root = way.pop()
            self.root.parent = None
            self.emit(self.root.edit, self.root.count, self.root.out)
            self.root.edit, self.root.out = "", None  # emitted: it neither grows nor holds a text

    def _way(self, node: Node) -> list[Node]:
        """From a survivor up to the root, which is left out."""
        way = []
        while node is not self.root:
            way.append(node)
            node = node.parent
        return way

    def finish(self) -> int:
        """Emit the rest of the cheapest whole repair and return its cost."""
        cost, _, node = min((s for s in (self.best[START], self.best[AFTER_A]) if s), key=lambda s: s[:2])
        for node in reversed(self._way(node)):
            self.emit(node.edit, node.count, node.out)
        return cost


def _or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """A fixed twentieth of the rows each: dropped, emptied, without stops, repeated, or given to the user."""
    t = turns.select("conv_id", "turn", _or_blank(F.col("role")).alias("role"), _or_blank(F.col("text")).alias("text"))
    key = F.concat(_or_blank(F.col("conv_id").cast("string")), F.lit(":"), _or_blank(F.col("turn").cast("string")))
    kind = F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(20))
    return (t.withColumn("_kind", kind).filter("_kind <> 0")
            .select("conv_id", "turn",
                    F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", r"[.!?]", ""))
                     .otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
            .drop("_copy"))


def with_faults(turns: DataFrame) -> DataFrame:
    """Rows with what is wrong on their own (``_fault``), and whether an earlier turn says the same (``_again``)."""
    t = turns.select("conv_id", "turn", _or_blank(F.col("role")).alias("role"), _or_blank(F.col("text")).alias("text"))
    ink = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    t = t.withColumn("_fault", F.when(ink == "", BLANK).when(~ink.isin(".", "!", "?"), CUT).otherwise(SOUND)) \
         .withColumn("_said", F.concat_ws(":", F.length("role").cast("string"), sha256_hex(F.concat("role", "text"))))
    firsts = (t.filter(F.col("_fault") != BLANK).groupBy("conv_id", "_said")
              .agg(F.count("*").alias("_n"), F.min("turn").alias("_first"), F.bool_or(F.col("turn").isNull()).alias("_null"))
              .filter("_n > 1").drop("_n").withColumnsRenamed({"conv_id": "_conv", "_said": "_same"}))
    later = F.when(F.col("_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("_first"))
    return (t.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_same")), "left")
            .select("conv_id", "turn", "role", "text", "_fault", F.coalesce(later, F.lit(False)).alias("_again")))


class _Conversation:
    """Counts and digest of one conversation while its rows stream by."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.counts = [0] * 4
        self.illegal = self.turns = 0
        self.low = self.high = self.last = None
        self.edits: list[str] = []
        self.digest, self.parts = hashlib.sha256(), 0
        self.repair = Repair(self._emit)

    def _emit(self, edit: str, count: int, out: tuple[str, str] | None) -> None:
        self.edits.append(edit * count)
        if len(self.edits) > 4096:
            self.edits = ["".join(self.edits)]
        if out:
            self.digest.update((("\n" if self.parts else "") + f"{out[0]}:{out[1]}").encode())
            self.parts += 1

    def add(self, turn, role: str, text: str, fault: int, again: bool) -> None:
        now = (turn, role, text)
        if fault != BLANK and (again or self.last == now):
            fault = REPEATED
        self.counts[fault] += 1
        if self.last and self.last[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None:
            self.turns += self.last is None or self.last[0] != turn
            self.low, self.high = turn if self.low is None else self.low, turn
        self.last = now
        self.repair.add(role, text, fault)

    def row(self) -> tuple:
        cost = self.repair.finish()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts[1:], self.illegal, cost, "".join(self.edits), self.digest.hexdigest())


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Faults and cheapest repair of each conversation that has rows."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, done = None, None, []
        for b in batches:
            schema = schema or pa.schema([("conv_id", b.schema.field(0).type), *[(c, pa.int64()) for c in
                                          ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                                          ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for conv_id, *row in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now.conv_id != conv_id:
                    done += [now.row()] if now else []
                    now = _Conversation(conv_id)
                now.add(*row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(now.row(), schema)], schema=schema)

    rows = with_faults(turns)
    return (rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
            .mapInArrow(run, out))
