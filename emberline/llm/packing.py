"""Best-fit packing of token pieces into sequences, by exact-complement hashing.

The plan needs only how many pieces there are of each length (at most ``capacity`` numbers, whatever
the data). It first consumes combinations of a length and one, two or three others that fill a
sequence exactly, looked up by the gap they must fill, as often as the counts allow; what is left
is packed best-fit. Pieces then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.byte_bpe import Vocabulary
from emberline.llm.common import col, map_batches, staged


class _Counts:
    """How many pieces are left of each length, and the patterns taken so far."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.patterns: list[tuple[tuple[int, ...], int]] = []

    def take(self, lengths: tuple[int, ...]) -> bool:
        """Consume the combination as often as the counts allow."""
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(self.left[x]) // n for x, n in need.items())
        if times > 0:
            for x, n in need.items():
                self.left[x] -= n * times
            self.patterns.append((lengths, times))
        return times > 0


def _exact(counts: _Counts, firsts: range, capacity: int, parts: int) -> None:
    """Combinations of a length of ``firsts`` and up to ``parts`` others that fill a sequence exactly.

    All single complements are consumed before pairs that sum to a gap, and pairs before triples.
    The index of sums is the availability table read from both ends: ``b`` goes with ``gap - b``.
    The longer part comes first, which saves short pieces for later. Each taking exhausts a
    length, or leaves too few of it for the combination.
    """
    left = counts.left
    for first in firsts:
        gap = capacity - first
        if gap == 0:
            counts.take((first,))
        elif gap <= first and left[first]:
            counts.take((first, gap))
    for first in firsts if parts > 1 else ():
        gap = capacity - first
        second = np.arange(min(first, gap - 1), (gap + 1) // 2 - 1, -1)
        if left[first] and len(second):
            for b in second[(left[second] > 0) & (left[gap - second] > 0)].tolist():
                counts.take((first, b, gap - b))
                if not left[first]:
                    break
    for first in firsts if parts > 2 else ():
        gap = capacity - first
        for b in range(min(first, gap - 2), (gap + 2) // 3 - 1, -1):
            if not left[first]:
                break
            if not left[b]:
                continue
            rest = gap - b
            third = np.arange(min(b, rest - 1), (rest + 1) // 2 - 1, -1)
            for c in third[(left[third] > 0) & (left[rest - third] > 0)].tolist():
                counts.take((first, b, c, rest - c))
                if not left[first] or not left[b]:
                    break


def _best_fit(counts: _Counts, capacity: int, above: int) -> None:
    """What is left, longest first, each into the fullest open sequence that has room.

    Only lengths over ``above`` open a sequence; others that find no room stay in ``counts``.
    """
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        need = int(counts.left[length])
        counts.left[length] = 0
        gap = length
        while need and gap <= capacity:
            waiting = open_.pop(gap, [])
            while waiting and need:
                pattern, bins = waiting.pop()
                fit = gap // length
                full = min(bins, need // fit)
                for used, n in ((fit, full), (need % fit, 1 if full < bins and need % fit else 0)):
                    if n and used:
                        open_.setdefault(gap - used * length, []).append((pattern + (length,) * used, n))
                        need -= used * n
                        bins -= n
                if bins:
                    waiting.append((pattern, bins))
                    if full == 0 and need:
                        break
            if waiting:
                open_.setdefault(gap, []).extend(waiting)
            gap += 1
        if length <= above:
            counts.left[length] = need
        elif need:
            fit = capacity // length
            for used, n in ((fit, need // fit), (need % fit, 1)):
                if n and used:
                    open_.setdefault(capacity - used * length, []).append(((length,) * used, n))
    counts.patterns += [p for same in open_.values() for p in same]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each, holding every piece counted once.

    Exact combinations can use up short pieces that best-fit would need elsewhere, so plans with up
    to three, two and one complements, from either end, are made, and the one with the fewest
    sequences is taken; of equal ones, that with more complements.
    """
    half, best = capacity // 2, None
    for parts in (3, 2, 1):
        for longest_first in (True, False):
            state = _Counts({x: n for x, n in counts.items() if n}, capacity)
            # no two lengths over half share a sequence, so their gaps are filled before others open any
            for firsts, above in ((range(capacity, half, -1), half), (range(half, 0, -1), 0)):
                _exact(state, firsts if longest_first else firsts[::-1], capacity, parts)
                _best_fit(state, capacity, above)
            size = sum(n for _, n in state.patterns)
            if best is None or size < best[0]:
                best = (size, state.patterns)
    return best[1]


#: Columns of :func:`plan_rows`.
PLAN = "length int, first long, last long, each int, sequence long, place int"


def plan_rows(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of a length go, by ranges of their rank among that length.

    A piece of ``length`` with rank r from ``first`` to before ``last`` goes to sequence ``sequence`` +
    (r - first) // each, at ``place`` + (r - first) % each * length.
    """
    rows, sequence, rank = [], 0, {}
    for lengths, times in patterns:
        place = 0
        for x in dict.fromkeys(lengths):
            each = lengths.count(x)
            first = rank.get(x, 0)
            rank[x] = first + each * times
            rows.append((x, first, rank[x], each, sequence, place))
            place += each * x
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with sequence_id and offset. They must be a stored table with the columns ``part``,
    ``length`` (1 to ``capacity``) and ``nth``, the rank of a row among those of its part and length.

    Nothing but the count of each length reaches the driver, and the plan that comes back has at
    most some lines for each taking, of which there are a few for each length; it is
    broadcast. Empty in, empty out.
    """
    spark = pieces.sparkSession
    blocks = staged(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = blocks.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    ranked = pieces.join(begins, ["part", "length"]).withColumn("rank", F.col("begin") + F.col("nth")).drop("begin")
    where = F.broadcast(spark.createDataFrame(plan_rows(plan(counts, capacity)), PLAN))
    nth = F.col("rank") - F.col("first")
    return (
        ranked.join(where, (ranked["length"] == where["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
        .select(
            *[pieces[c] for c in pieces.columns],
            (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("place") + nth % F.col("each") * ranked["length"]).cast("long").alias("offset"),
        )
    )


def cut(size: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of ``size`` tokens; only the first may be short."""
    first = (size - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, size, capacity))]


def tokenise_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, part, nth; stored in the work folder."""
    known = Vocabulary(docs, vocabulary)

    def each(batches: Iterator[pa.RecordBatch]):
        bpe, part, seen = known.load(), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, counts = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
            ends = np.cumsum(counts)
            whose, out = [], []
            for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
                own = np.append(ids[a:b], end_id).astype("<u4")
                for n, (start, length) in enumerate(cut(len(own), capacity)):
                    whose.append(i)
                    out.append((n, start, length, zlib.crc32(own[start : start + length]), part, int(seen[length])))
                    seen[length] += 1
            columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = [id, "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose, pa.int64())), *arrays], names=names)

    narrow = docs.select(col(id), col(text))
    fields = [T.StructField(c, k) for c, k in (
        ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()),
        ("part", T.IntegerType()), ("nth", T.LongType()),
    )]
    return staged(map_batches(narrow, each, T.StructType([narrow.schema[0], *fields])))


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece of each row of ``docs``: id, piece, start, length, ids_crc32, sequence_id, offset.

    A text's tokens (a null text has none) and ``end_id`` are cut into pieces of ``capacity``, of which
    only the first may be shorter, and the pieces are packed into as few sequences of ``capacity`` as
    the method finds. Repeated rows are packed one by one. Other columns, whatever their names, are
    not read. Empty in, empty out.
    """
    pieces = tokenise_pieces(docs, vocabulary, end_id, capacity, id, text)
    return pack(pieces, capacity).drop("part", "nth")
