"""Structure repair of conversations with Four-Russians block tables.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant
turns. Turns are kept, given another role, deleted or inserted at the least cost. The cost of what
still has to be done is a vector over the four states of that pattern; less its minimum, few such
vectors exist. A table therefore holds, for every vector and every block of ``BLOCK`` turn classes,
the vector before the block, and a conversation is read block by block, from its end. Its edits are
then traced from its start: each block is expanded backward into the vectors between its turns, and
of equally cheap edits the first in ASCII order is taken, which makes the whole string the least.

Costs over a stretch of turns compose (as 4 x 4 matrices in min-plus arithmetic), so long
conversations are cut into chunks that are read and traced in parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.common import col, map_batches, staged

#: Turn classes looked up at once, and turn classes of one chunk.
BLOCK, CHUNK = 4, 1 << 16
#: Costs of edits; a truncated turn that stays costs TRUNCATED more.
DELETE, RENAME, INSERT, TRUNCATED = 2, 1, 5, 5
#: White space in ASCII; a text of nothing else is blank.
SPACE = " \t\n\x0b\x0c\r"

#: Classes: 2 * (number of the initial in INITIALS) + truncated, then blank and duplicate.
INITIALS = "sua"
BLANK, DUPLICATE, CLASSES = 8, 9, 9
#: States: nothing yet, after system, after user, after assistant. Where a user or assistant turn leads to.
ACCEPT, TURN_TO = (0, 3), (2, 2, 3, 2)
NEVER = 1 << 20

Vector = tuple[int, ...]

# ---------------------------------------------------------------- tables


def _kept(initial: int, state: int) -> int | None:
    """The state after a turn with this initial, if it may follow."""
    if initial == 0:
        return 1 if state == 0 else None
    return TURN_TO[state] if initial in (1, 2) and TURN_TO[state] == initial + 1 else None


def _with_inserts(costs: Vector) -> Vector:
    for _ in range(2):
        costs = tuple(min(c, INSERT + costs[TURN_TO[s]]) for s, c in enumerate(costs))
    return costs


def _edits(after: Vector, kind: int, state: int) -> dict[str, tuple[int, int]]:
    """Edit: (cost with all that follows, next state) of one turn, without insertions before it."""
    found = {"D": (DELETE + after[state], state)}
    if kind < BLANK:
        initial, more = kind // 2, TRUNCATED * (kind % 2)
        if (to := _kept(initial, state)) is not None:
            found["K"] = (more + after[to], to)
        found["R"] = (more + RENAME + after[TURN_TO[state]], TURN_TO[state])
    return found


def _before(after: Vector, kind: int) -> Vector:
    return _with_inserts(tuple(min(NEVER, *(c for c, _ in _edits(after, kind, s).values())) for s in range(4)))


def _normal(costs: Vector) -> tuple[Vector, int]:
    low = min(costs)
    return tuple(NEVER if c >= NEVER // 2 else c - low for c in costs), low


#: Costs at the end of a conversation, and at the end of a chunk that must end in one state.
END = _with_inserts(tuple(0 if s in ACCEPT else NEVER for s in range(4)))
ENDS_IN = [_with_inserts(tuple(0 if s == q else NEVER for s in range(4))) for q in range(4)]


class Tables:
    """All normalised cost vectors by number, and what one turn or one block makes of each."""

    def __init__(self, block: int = BLOCK):
        self.vectors: list[Vector] = []
        self.number: dict[Vector, int] = {}
        for seed in (END, *ENDS_IN):
            self._add(_normal(seed)[0])
        steps = []
        for vector in self.vectors:  # grows while it is read
            steps.append([(self._add(v), low) for v, low in (_normal(_before(vector, k)) for k in range(CLASSES))])
        one, cost = (np.array([[x[i] for x in row] for row in steps], np.int32) for i in (0, 1))
        self.block, to, paid = block, one, cost
        for _ in range(block - 1):  # one more turn in front of what is known
            # codes count the first turn of a block highest
            ahead = one[to]  # vector, code, class of the new first turn
            more = cost[to] + paid[:, :, None]
            to, paid = (np.swapaxes(x, 1, 2).reshape(len(one), -1) for x in (ahead, more))
        self.one, self.one_cost = one.tolist(), cost.tolist()
        self.to, self.paid = to.tolist(), paid.tolist()
        self.choices = [[[self._choose(v, k, s) for s in range(4)] for k in range(CLASSES)] for v in self.vectors]

    def _add(self, vector: Vector) -> int:
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector]

    def _choose(self, after: Vector, kind: int, state: int) -> tuple[str, int] | None:
        """The ASCII-least cheapest edits up to and with this turn, and the next state."""
        best, edits = _before(after, kind), ""
        if best[state] >= NEVER // 2:
            return None
        while True:
            least = best[state]
            own = {e: to for e, (c, to) in _edits(after, kind, state).items() if c == least}
            if "D" in own or INSERT + best[TURN_TO[state]] > least:
                edit = min(own)
                return edits + edit, own[edit]
            edits, state = edits + "I", TURN_TO[state]

    def read(self, kinds: np.ndarray, after: int) -> tuple[list[int], int]:
        """Vectors before each block, then the one at the end; and the cost taken off on the way.

        The first block holds what is left when the others have full length.
        """
        first, size = len(kinds) % self.block, self.block
        codes = (kinds[first:].reshape(-1, size) @ (CLASSES ** np.arange(size)[::-1])).tolist()
        found, total, to, paid = [after], 0, self.to, self.paid
        for code in reversed(codes):
            total += paid[after][code]
            after = to[after][code]
            found.append(after)
        if first:
            for kind in reversed(kinds[:first].tolist()):
                total += self.one_cost[after][kind]
                after = self.one[after][kind]
            found.append(after)
        return found[::-1], total

    def matrix(self, kinds: np.ndarray) -> list[int]:
        """Least cost from each state before to each state after, row by row."""
        columns = []
        for q in range(4):
            found, total = self.read(kinds, self.number[_normal(ENDS_IN[q])[0]])
            columns.append([min(NEVER, c + total) for c in self.vectors[found[0]]])
        return [columns[q][s] for s in range(4) for q in range(4)]

    def trace(self, kinds: np.ndarray, after: int, states=range(4)) -> list[tuple[str, int] | None]:
        """For each state before: the least edits and the state after; none where the end cannot be reached."""
        found, _ = self.read(kinds, after)
        first, turns, choices = len(kinds) % self.block, kinds.tolist(), self.choices
        cuts = [0, first] if first else [0]
        cuts += range(cuts[-1] + self.block, len(turns) + 1, self.block)
        at: list[int | None] = [s if self.vectors[found[0]][s] < NEVER // 2 else None for s in states]
        edits: list[list[str]] = [[] for _ in states]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            inner = [found[i + 1]]
            for kind in reversed(turns[a + 1 : b]):
                inner.append(self.one[inner[-1]][kind])
            for kind, vector in zip(turns[a:b], reversed(inner), strict=True):
                chosen = choices[vector][kind]
                for j, s in enumerate(at):
                    if s is not None:
                        edit, at[j] = chosen[s]
                        edits[j].append(edit)
        return [None if s is None else ("".join(e), s) for e, s in zip(edits, at, strict=True)]


@cache
def tables() -> Tables:
    return Tables()


# ---------------------------------------------------------------- classes of turns


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    named = rows.select(
        col(conv).alias("conv"), col(turn).alias("turn"), F.coalesce(col(role), F.lit("")).alias("role"), F.coalesce(col(text), F.lit("")).alias("text"),
    )
    return named.withColumn("digest", F.unhex(F.md5("text")))


def _classes(turns: DataFrame) -> DataFrame:
    """conv, turn, role, digest, kind and ``copies`` of each different turn; of the copies the first has the kind."""
    stripped = F.rtrim("text", F.lit(SPACE))
    cut = ~F.right(stripped, F.lit(1)).isin(".", "!", "?")
    initial = F.coalesce(*[F.when(F.col("role").startswith(c), i) for i, c in enumerate(INITIALS)], F.lit(len(INITIALS)))
    kind = F.when(stripped == "", BLANK).otherwise(2 * initial + cut.cast("int"))
    once = turns.select("conv", "turn", "role", "digest", kind.alias("kind")).groupBy("conv", "turn", "role", "digest", "kind").agg(F.count("*").alias("copies"))
    said = once.where(F.col("kind") != BLANK).groupBy("conv", "role", "digest")
    several = said.agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1").toDF("c", "r", "d", "first", "n")
    same = once["conv"].eqNullSafe(several["c"]) & (once["role"] == several["r"]) & (once["digest"] == several["d"])
    again = (F.col("kind") != BLANK) & (F.struct("turn") > F.col("first"))
    marked = once.join(several, same, "left").withColumn("kind", F.when(again, DUPLICATE).otherwise(F.col("kind")))
    return marked.select("conv", "turn", "role", "digest", "kind", "copies")


_CHUNK = "part int, nth int, kinds binary, costs array<int>"


def _chunks(classes: DataFrame) -> DataFrame:
    """Stretches of conversations in order: conv, part and nth (their order), kinds (a byte a turn) and their cost matrix."""
    conv = classes.schema["conv"]

    def each(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part, nth, known = TaskContext.get().partitionId(), 0, tables()
        rows, held, size, now = [], [], 0, None

        def close():
            nonlocal held, size, nth
            if size:
                kinds = np.frombuffer(b"".join(held), np.uint8)
                rows.append((now[0], part, nth, kinds.tobytes(), known.matrix(np.minimum(kinds, BLANK))))
                held, size, nth = [], 0, nth + 1

        def batch_of(rows):
            fields = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (kind, pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32())), strict=True)]
            return pa.RecordBatch.from_arrays(fields, names=["conv", "part", "nth", "kinds", "costs"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for c, k, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now is None or c != now[0]:
                    close()
                    now = (c,)
                again = BLANK if k == BLANK else DUPLICATE
                held.append(bytes([k]))
                size, n = size + 1, n - 1
                while n or size >= CHUNK:
                    if size >= CHUNK:
                        close()
                    some = min(n, CHUNK - size)
                    held.append(bytes([again]) * some)
                    size, n = size + some, n - some
                if len(rows) >= 4096 or (rows and len(rows) * CHUNK >= 1 << 24 and size > CHUNK // 2):
                    yield batch_of(rows)
                    rows = []
        close()
        if rows:
            yield batch_of(rows)

    keys = ["conv", "turn", "role", "digest"]
    ordered = classes.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "kind", "copies")
    return map_batches(ordered, each, T.StructType([conv, *T.StructType.fromDDL(_CHUNK)]))


# ---------------------------------------------------------------- costs between chunks, edits inside


def _ends(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``after``, the normalised costs at the end of each: a scan over matrices, from the last."""

    def each(batches):
        now, costs = None, END
        for batch in batches:
            after = []
            for c, m in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if now is None or c != now[0]:
                    now, costs = (c,), END
                after.append(list(costs))
                costs = _normal(tuple(min(m[4 * s + q] + costs[q] for q in range(4)) for s in range(4)))[0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(after, pa.list_(pa.int32()))], names=[*batch.schema.names[:4], "after"])

    last = chunks.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("nth"))
    schema = T.StructType([*chunks.schema[:4], T.StructField("after", T.ArrayType(T.IntegerType()))])
    return map_batches(last, each, schema)


def _traced(chunks: DataFrame) -> DataFrame:
    """conv, part, nth, kinds and, for each state before the chunk, ``edits`` and the state after (-1: none)."""

    def each(batches):
        known = tables()
        for batch in batches:
            edits, states = [], []
            for kinds, after in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                found = known.trace(np.minimum(np.frombuffer(kinds, np.uint8), BLANK), known.number[_normal(tuple(after))[0]])
                edits.append([f[0] if f else None for f in found])
                states.append([f[1] if f else -1 for f in found])
            more = [pa.array(edits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *more], names=[*batch.schema.names[:4], "edits", "states"])

    schema = T.StructType([*chunks.schema[:4], *T.StructType.fromDDL("edits array<string>, states array<int>")])
    return map_batches(chunks.repartition("conv", "part", "nth"), each, schema)


_OUT = "seq long, edit string, fault string, turn_role string, role string, text string"
_FAULTS = {BLANK: "blank", DUPLICATE: "duplicate"}


class _Plan:
    """The edits of one conversation, taken turn by turn."""

    def __init__(self):
        self.edits, self.kinds, self.start, self.state, self.i, self.at, self.seq = [], [], 0, 0, 0, 0, -1

    def add(self, kinds: bytes, edits: list[str | None], states: list[int]) -> None:
        self.edits.append(edits[self.start])
        self.kinds.append(kinds)
        self.start = states[self.start]

    def join(self) -> None:
        self.edits, self.kinds = "".join(self.edits), b"".join(self.kinds)

    def inserts(self):
        while self.i < len(self.edits) and self.edits[self.i] == "I":
            yield self._row("I", None, None, None, self._next(), "")

    def turn(self, role: str, text: str):
        yield from self.inserts()
        kind, edit = self.kinds[self.at], self.edits[self.i]
        self.at += 1
        fault = _FAULTS.get(kind, "truncated" if kind % 2 else None)
        if edit == "D":
            yield self._row("D", fault, role, None, None, None)
        elif edit == "R":
            yield self._row("R", fault, role, None, self._next(), text)
        else:
            self.state = _kept(INITIALS.index(role[0]), self.state)
            yield self._row("K", fault, role, None, role, text)

    def rest(self):
        """Insertions after the last turn."""
        while self.state not in ACCEPT:
            yield self._row("I", None, None, None, self._next(), "")

    def _next(self) -> str:
        self.state = TURN_TO[self.state]
        return "user" if self.state == 2 else "assistant"

    def _row(self, edit, fault, old, _, role, text):
        self.i, self.seq = self.i + 1, self.seq + 1
        return self.seq, edit, fault, old, role, text


def _applied(turns: DataFrame, traced: DataFrame) -> DataFrame:
    """All turns of a conversation in order, each conversation whole within one partition, with their edits."""
    plan = traced.select("conv", F.lit(0).alias("said"), "part", "nth", "kinds", "edits", "states")
    stream = plan.unionByName(turns.withColumn("said", F.lit(1)), allowMissingColumns=True)
    stream = stream.repartition("conv").sortWithinPartitions("conv", "said", "part", "nth", "turn", "role", "digest")
    stream = stream.select("conv", "said", "kinds", "edits", "states", "turn", "role", "text")
    schema = T.StructType([turns.schema["conv"], turns.schema["turn"], *T.StructType.fromDDL(_OUT)])

    def each(batches):
        now, plan = None, _Plan()
        for batch in batches:
            rows = []

            def take(turn, found):
                rows.extend((now[0], turn if row[3] is not None else None, *row) for row in found)

            for c, said, kinds, edits, states, turn, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now is None or c != now[0]:
                    take(None, plan.rest())
                    now, plan = (c,), _Plan()
                if said:
                    if isinstance(plan.kinds, list):
                        plan.join()
                    take(turn, plan.turn(role, text))
                else:
                    plan.add(kinds, edits, states)
            yield _batch(rows, batch.schema.field(0).type, batch.schema.field(5).type)
        if now is not None:
            yield _batch([(now[0], None, *row) for row in plan.rest()], batch.schema.field(0).type, batch.schema.field(5).type)

    def _batch(rows, conv, turn):
        kinds = (conv, turn, pa.int64(), *[pa.string()] * 5)
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=schema.names)

    return map_batches(stream, each, schema)


def repair_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every turn with its edit: conv, turn, seq, edit (D, I, K or R), fault, turn_role, role and text.

    Turns go by ``turn``, nulls first, then by role and by a digest of the text; ``seq`` counts them with the
    inserted ones from 0. ``fault`` is blank, duplicate (role and text seen earlier in the conversation) or
    truncated, or null. ``role`` and ``text`` are those after repair, null for deleted turns; ``turn_role`` is
    the role before, null for inserted ones. A null role or text counts as empty, a null conversation is one
    like any other, and repeated rows are duplicates. Other columns are not read. Empty in, empty out.

    Chunks of a long conversation are read and traced in parallel. The last pass streams each conversation
    in order through one task, which holds two bytes a turn of the conversation at hand.
    """
    turns = _turns(rows, conv, turn, role, text)
    chunks = staged(_chunks(_classes(turns)))
    return _applied(turns, _traced(_ends(chunks)))


def report(turns: DataFrame) -> DataFrame:
    """One row a conversation from the output of :func:`repair_turns`: counts, cost, audit and a digest of the repaired text.

    ``gaps`` are turn numbers that are missing between the first and the last; ``illegal`` counts neighbours,
    before repair, whose initials may not follow each other. It reads each partition as it comes, so ``turns`` must be
    the unchanged output.
    """

    def each(batches):
        rows, now, x = [], None, None

        def close():
            if now is not None:
                turns = x["turns"]
                gaps = int(x["last"] - x["low"] + 1 - turns) if turns else 0
                rows.append((now[0], gaps, x["blank"], x["duplicate"], x["truncated"], x["illegal"], x["cost"], "".join(x["audit"]), x["sha"].hexdigest()))

        for batch in batches:
            kind = batch.schema.field(0).type
            for c, turn, _, edit, fault, old, role, text in zip(*(y.to_pylist() for y in batch.columns), strict=True):
                if now is None or c != now[0]:
                    close()
                    now = (c,)
                    x = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "turns": 0, "low": None, "last": None, "old": None, "any": False}
                x["audit"].append(edit)
                x["cost"] += {"D": DELETE, "R": RENAME, "I": INSERT, "K": 0}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                if fault:
                    x[fault] += 1
                if old is not None:
                    if x["old"] is not None and x["old"][:1] + old[:1] not in ("su", "ua", "au"):
                        x["illegal"] += 1
                    x["old"] = old
                    if turn is not None and turn != x["last"]:
                        x["turns"] += 1
                        x["low"] = turn if x["low"] is None else x["low"]
                        x["last"] = turn
                if edit != "D":
                    x["sha"].update((("\n" if x["any"] else "") + f"{role}:{text}").encode())
                    x["any"] = True
            if len(rows) >= 1024:
                yield batch_of(rows, kind)
                rows = []
        close()
        if rows:
            yield batch_of(rows, kind)

    def batch_of(rows, kind):
        kinds = (kind, *[pa.int64()] * 6, pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    counts = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    schema = T.StructType([turns.schema["conv"], *T.StructType.fromDDL(counts)])
    return map_batches(turns, each, schema)
