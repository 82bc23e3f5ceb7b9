"""Repair of conversation structure at the least cost: an optional system turn, then user and assistant in turn.

Method: survivor-coalescence Viterbi. Rows stream through a task in the order
of their conversation. For each of the four ends that a repaired beginning can
have (nothing, system, user, assistant) one cheapest path survives. The paths
share a tree of edits with reference counts; as soon as all survivors have one
ancestor, its edits are final and leave the tree, so what is held is the
unresolved part only. Ties go to the path whose edits come first in ASCII order:
the edits that follow the last common ancestor of two tied paths are compared,
which decides for their complete suffixes, because edits out of one point of
the tree differ. Each survivor carries its own running digest, so no text is
held at all.

A path is dropped only if another survivor is cheaper by more than the first
could ever win back (``_BOUNDS``), which keeps ties whole.

Defined cases: nulls are one blank. Rows of one turn stand in order of role
and text. Rows without conversation id are one conversation. A role is told
by its first character; a role without one is none. Columns other than the four
named are not read. A conversation none of whose rows is left has zeros, an empty
audit and the digest of an empty text. Gaps are at most 2^63 - 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depsignal.llm.storage import width

#: Costs and marks (fixed values).
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
LEGAL = frozenset({("s", "u"), ("u", "a"), ("a", "u")})

#: What the repaired beginning ends with.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: (y, x, d): whatever a path that ends in x can still do, one that ends in y can do for at most d more.
_BOUNDS = [
    (ASSISTANT, NOTHING, 3), (ASSISTANT, SYSTEM, 0), (ASSISTANT, USER, 2),
    (USER, NOTHING, 5), (USER, SYSTEM, 2), (USER, ASSISTANT, 2),
    (SYSTEM, NOTHING, 4), (SYSTEM, USER, 2), (SYSTEM, ASSISTANT, 4),
    (NOTHING, SYSTEM, 0), (NOTHING, USER, 2), (NOTHING, ASSISTANT, 0),
]


class _Node:
    """Some edits in a row of the tree; ``live`` is the survivor that ends here, or -1."""

    __slots__ = ("up", "letters", "kids", "live")

    def __init__(self, up: _Node | None, letters: bytes, live: int):
        self.up, self.letters, self.kids, self.live = up, bytearray(letters), [], live


class Survivors:
    """The cheapest path to each end, after the rows taken so far."""

    def __init__(self):
        root = _Node(None, b"", NOTHING)
        self.root = root
        self.node: list[_Node | None] = [root, None, None, None]
        self.cost = [0, 0, 0, 0]
        self.digest: list = [hashlib.sha256(), None, None, None]
        self.audit = bytearray()

    def _chain(self, node: _Node) -> list[_Node]:
        found = []
        while node is not None:
            found.append(node)
            node = node.up
        return found[::-1]

    def _before(self, node: _Node, letter: int, other: _Node, other_letter: int) -> bool:
        """Whether the edits to ``node`` and then ``letter`` come before those to ``other`` and then ``other_letter``."""
        if node is other:
            return letter < other_letter
        a, b = self._chain(node), self._chain(other)
        k = 0
        while k < len(a) and k < len(b) and a[k] is b[k]:
            k += 1
        return (a[k].letters[0] if k < len(a) else letter) < (b[k].letters[0] if k < len(b) else other_letter)

    def _settle(self, node: _Node) -> None:
        """Free a node that nothing refers to, join one that a single node refers to, and emit what all paths share."""
        while node is not None and node.live < 0 and not node.kids:
            up = node.up
            if up is not None:
                up.kids.remove(node)
            node = up
        if node is None or node.live >= 0 or len(node.kids) != 1:
            return
        kid = node.kids[0]
        if node is self.root:
            self.root, kid.up = kid, None
            self.audit += kid.letters
            kid.letters = bytearray()
            self._settle(kid)
        elif len(kid.letters) <= len(node.letters):
            node.letters += kid.letters
            node.kids, node.live = kid.kids, kid.live
            for k in node.kids:
                k.up = node
            if node.live >= 0:
                self.node[node.live] = node
        else:
            kid.letters[:0] = node.letters
            kid.up = node.up
            node.up.kids[node.up.kids.index(node)] = kid

    def _drop(self, end: int) -> None:
        node = self.node[end]
        self.node[end] = None
        node.live = -1
        self._settle(node)

    def _grow(self, end: int, up: _Node, letter: bytes) -> None:
        node = _Node(up, letter, end)
        up.kids.append(node)
        self.node[end] = node

    def _fed(self, end: int, into: int, role: bytes, text: bytes) -> object:
        """The digest of a path after one more line of output."""
        digest = self.digest[end].copy()
        digest.update(b"\n" + role + b":" if end != NOTHING else role + b":")
        digest.update(text)
        return digest

    def _insert(self) -> None:
        """Let empty turns be put in here, where that is cheaper or comes first; then drop hopeless paths."""
        for end, sources, role in ((USER, (NOTHING, SYSTEM, ASSISTANT), b"user"), (ASSISTANT, (USER,), b"assistant")):
            best = None
            for s in sources:
                if self.node[s] is None:
                    continue
                cost = self.cost[s] + INSERT
                if best is None or cost < self.cost[best] + INSERT or (
                    cost == self.cost[best] + INSERT and self._before(self.node[s], 73, self.node[best], 73)
                ):
                    best = s
            if best is None:
                continue
            cost = self.cost[best] + INSERT
            if self.node[end] is not None:
                # a path that ends here already has no further edit, so the other one decides below their ancestor
                if cost > self.cost[end] or cost == self.cost[end] and not self._before(self.node[best], 73, self.node[end], 0):
                    continue
            digest = self._fed(best, end, role, b"")
            # the new node is put in first, so that its parent is never left without a reference
            source, old = self.node[best], self.node[end]
            self._grow(end, source, b"I")
            self.cost[end], self.digest[end] = cost, digest
            if old is not None:
                old.live = -1
                self._settle(old)
        for y, x, more in _BOUNDS:
            if self.node[y] is not None and self.node[x] is not None and self.cost[x] > self.cost[y] + more:
                self._drop(x)

    def take(self, role: str, text: bytes, forced: bool, cut_off: bool) -> None:
        """Go on by one row; a ``forced`` one can only be deleted, a ``cut_off`` one costs more if it stays."""
        self._insert()
        if forced:
            for end in range(4):
                if self.node[end] is not None:
                    self.cost[end] += DELETE
                    if self.node[end].kids:
                        self.node[end].live = -1
                        self._grow(end, self.node[end], b"D")
                    else:
                        self.node[end].letters += b"D"
                        if self.node[end] is self.root:
                            self.audit += self.root.letters
                            self.root.letters = bytearray()
            return
        initial, extra = role[:1], CUT_OFF if cut_off else 0
        ways: dict[int, list[tuple[int, int, int]]] = {}
        for end in range(4):
            if self.node[end] is None:
                continue
            cost = self.cost[end]
            ways.setdefault(end, []).append((cost + DELETE, end, 68))
            into = ASSISTANT if end == USER else USER
            if initial == ("a" if end == USER else "u"):
                ways.setdefault(into, []).append((cost + extra, end, 75))
            ways.setdefault(into, []).append((cost + REROLE + extra, end, 82))
            if end == NOTHING and initial == "s":
                ways.setdefault(SYSTEM, []).append((cost + extra, end, 75))
        chosen = {}
        for into, found in ways.items():
            best = found[0]
            for way in found[1:]:
                if way[0] < best[0] or way[0] == best[0] and self._before(self.node[way[1]], way[2], self.node[best[1]], best[2]):
                    best = way
            chosen[into] = best
        old, digests = self.node, {}
        for into, (_, end, letter) in chosen.items():
            if letter == 68:
                digests[into] = self.digest[end]
            else:
                name = role.encode() if letter == 75 else b"assistant" if into == ASSISTANT else b"user"
                digests[into] = self._fed(end, into, name, text)
        for node in old:
            if node is not None:
                node.live = -1
        self.node = [None] * 4
        for into, (cost, end, letter) in chosen.items():
            self._grow(into, old[end], bytes([letter]))
            self.cost[into], self.digest[into] = cost, digests[into]
        for node in old:
            # one that was joined or freed on the way is no longer in the tree
            if node is not None and (node is self.root or node.up is not None and node in node.up.kids):
                self._settle(node)

    def held(self) -> int:
        """How many unresolved edits the tree holds."""
        total, todo = 0, [self.root]
        while todo:
            node = todo.pop()
            total += len(node.letters)
            todo += node.kids
        return total

    def finish(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest whole repair."""
        self._insert()
        ends = [e for e in (NOTHING, ASSISTANT) if self.node[e] is not None]
        best = ends[0]
        for end in ends[1:]:
            less = self.cost[end] < self.cost[best]
            if less or self.cost[end] == self.cost[best] and self._before(self.node[end], 0, self.node[best], 0):
                best = end
        rest = b"".join(bytes(n.letters) for n in self._chain(self.node[best]))
        return self.cost[best], (bytes(self.audit) + rest).decode(), self.digest[best].hexdigest()


class _Conversation:
    """Faults, gaps and the repair of one conversation whose rows come in order."""

    def __init__(self, name):
        self.name, self.paths = name, Survivors()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def take(self, turn, role: str, text: str, repeated: bool) -> None:
        if turn is not None:
            if self.first is None:
                self.first = turn
            self.turns += turn != self.last
            self.last = turn
        shown = text.rstrip(BLANKS)
        blank = not shown
        cut_off = not blank and not repeated and shown[-1] not in STOPS
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += cut_off
        initial = role[:1]
        self.illegal += self.before is not None and (self.before, initial) not in LEGAL
        self.before = initial
        self.paths.take(role, text.encode(), blank or repeated, cut_off)

    def result(self) -> tuple:
        gaps = 0 if self.first is None else min(int(self.last - self.first) + 1 - self.turns, 2**63 - 1)
        return (self.name, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.paths.finish())


def _streamed(schema: pa.Schema):
    def conversations(batches: Iterator[pa.RecordBatch]):
        current = None
        for batch in batches:
            for name, turn, role, text, gone, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or name != current.name:
                    if current is not None:
                        yield current.result()
                    current = _Conversation(name)
                if not gone:
                    current.take(turn, role, text, repeated)
        if current is not None:
            yield current.result()

    def run(batches):
        rows = []
        for row in conversations(batches):
            rows.append(row)
            if len(rows) == 10_000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _plain(rows: DataFrame, conv: str, turn: str, role: str, text: str, *more: Column) -> DataFrame:
    """The four columns under their own names, nulls of role and text as one blank, and further ones."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = (F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    return rows.select(*named, *more)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with one of five faults in a quarter of them, chosen by the hash of conversation and turn.

    A dropped row stays as a mark (``gone``), so that its conversation is reported.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    plain = _plain(rows, conv, turn, role, text).withColumn("_kind", kind)
    found = plain.select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") <= 1, "").when(F.col("_kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text")).alias("text"),
        (F.col("_kind") == 0).alias("gone"),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    )
    return found.drop("_copy")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """One row per conversation: its faults, and the cheapest repair as cost, audit and digest.

    Rows for which ``gone`` holds only name their conversation. One exchange
    brings a conversation together; repeats are numbered and rows are put in
    order inside the partition, by sorts that spill.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = rows.schema[conv].dataType
    lost = F.lit(False) if gone is None else F.coalesce(F.col(gone), F.lit(False))
    plain = _plain(rows, conv, turn, role, text, lost.alias("gone"))
    dealt = plain.repartition(width(rows.sparkSession), "conv_id")
    same = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())
    marked = dealt.withColumn("repeated", F.row_number().over(same) > 1)
    ordered = marked.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "repeated")
    schema = T.StructType([T.StructField("conv_id", kind)])
    for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
        schema = schema.add(name, "long")
    schema = schema.add("audit", "string").add("repaired_sha256", "string")
    return ordered.mapInArrow(_streamed(to_arrow_schema(schema)), schema)


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place, role, text, edit) of every row that stays, changes its role or is put in.

    ``rows`` are (conv_id, turn, role, text) as given to ``repair``, ``found`` its result.
    """
    plain = _plain(rows, "conv_id", "turn", "role", "text")
    at = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = plain.withColumn("row", F.row_number().over(at)).withColumnRenamed("conv_id", "_conv").drop("turn")
    letters = found.select("conv_id", F.posexplode(F.split("audit", "")).alias("at", "edit")).filter("edit <> ''")
    so_far = Window.partitionBy("conv_id").orderBy("at")
    edits = letters.withColumns(
        {"row": F.count_if(F.col("edit") != "I").over(so_far), "place": F.count_if(F.col("edit") != "D").over(so_far)}
    )
    rows_of = edits.filter("edit <> 'D'").join(
        numbered, F.col("conv_id").eqNullSafe(F.col("_conv")) & (edits["row"] == numbered["row"]) & (F.col("edit") != "I"), "left"
    )
    opened = F.max(F.when((F.col("place") == 1) & F.col("role").startswith("s") & (F.col("edit") == "K"), 1).otherwise(0))
    turned = F.when((F.col("place") - opened.over(Window.partitionBy("conv_id"))) % 2 == 1, "user").otherwise("assistant")
    return rows_of.select(
        "conv_id",
        "place",
        F.when(F.col("edit") == "K", F.col("role")).otherwise(turned).alias("role"),
        F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"),
        "edit",
    )

