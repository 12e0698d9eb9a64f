"""Hard negatives from Hilbert-ordered blocks with zone maps.

Vectors are written as Parquet blocks in the order of a Hilbert curve, each with the minimum and
maximum of every dimension. From those, interval arithmetic bounds the inner products of an anchor
with all rows of a block. An anchor's own block gives it a first threshold for its positives (the
most similar rows of its label); blocks that cannot reach it are not read. The scores of the
positives then fix the windows of the negatives, and a block is read for an anchor if its bounds
meet one of the windows. All scores are exact integers, so what is skipped cannot change the result.

Anchors travel in groups and blocks as one row each; every join is on their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import col, map_batches, staged

#: Rows of a block, anchors of a group, zone maps bounded at once, and tasks that share the blocks of a group.
BLOCK_BITS, GROUP, PAGE, SLICES = 10, 1024, 1024, 8
#: The curve runs through the first dimensions, on a grid of so many bits each.
CURVE_DIMS, CURVE_BITS = 64, 2
#: Sums below this are exact in double precision, with room for the factors of a window.
EXACT = 2.0**53 / 100

# ---------------------------------------------------------------- vectors


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points on a grid of ``bits`` a dimension, as big-endian rows of bytes."""
    x = cells.astype(np.uint32).T.copy()
    step = 1 << (bits - 1)
    while step > 1:
        below = np.uint32(step - 1)
        for axis in x:
            far = (axis & np.uint32(step)) != 0
            swap = np.where(far, 0, (x[0] ^ axis) & below).astype(np.uint32)
            x[0] ^= np.where(far, below, swap).astype(np.uint32)
            axis ^= swap
        step >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    step = 1 << (bits - 1)
    while step > 1:
        flip ^= np.where(x[-1] & np.uint32(step), np.uint32(step - 1), np.uint32(0))
        step >>= 1
    x ^= flip
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in reversed(range(bits))]
    return np.packbits(np.concatenate(planes).astype(np.uint8).T, axis=1)


def padded(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of doubles, shorter ones filled up with zeros."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


@dataclass(frozen=True)
class Shape:
    """What all vectors of a table have in common: dimensions, least and greatest component, bytes a component."""

    width: int
    low: float
    high: float

    @property
    def kind(self) -> str:
        return "<f4" if max(abs(self.low), abs(self.high)) < 1 << 24 else "<f8"

    def pack(self, x: np.ndarray) -> bytes:
        return np.ascontiguousarray(x, self.kind).tobytes()

    def unpack(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.kind).reshape(-1, self.width).astype(np.float64)

    def keys(self, x: np.ndarray) -> np.ndarray:
        share = (x[:, :CURVE_DIMS] - self.low) / (self.high - self.low + 1)
        return hilbert_keys(np.floor(share * (1 << CURVE_BITS)), CURVE_BITS)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; Python's integers where doubles would round."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < EXACT:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(a) @ whole(b).T


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``a`` with any point of each box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    least, most = products(up, low) + products(down, high), products(up, high) + products(down, low)
    return least, most


# ---------------------------------------------------------------- blocks and groups


def _taking_part(rows: DataFrame, anchors: Column, id: str, vector: str, label: str, scale: float) -> DataFrame:
    whole = F.transform(col(vector), lambda x: F.lit(float(scale)) * x.cast("double"))
    named = rows.select(col(id).cast("long").alias("id"), col(label).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), whole.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return named.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def _shape(rows: DataFrame) -> Shape | None:
    least, most = F.min(F.array_min("vector")), F.max(F.array_max("vector"))
    n, width, low, high = rows.agg(F.count("*"), F.max(F.size("vector")), least, most).first()
    return Shape(max(1, width), np.floor(low or 0.0), np.floor(high or 0.0)) if n else None


_BLOCKS = "block long, ids array<long>, labels array<long>, anchors array<int>, vectors binary, low binary, high binary, one_label long"


def _blocks(rows: DataFrame, shape: Shape) -> DataFrame:
    """The rows in blocks along the curve, with their zone maps; row ``i`` of a block has the number block << BLOCK_BITS | i."""

    def keyed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = np.floor(padded(batch.column(3), shape.width))
            keys, raw = shape.keys(x), x.astype(shape.kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k.tobytes() for k in keys], pa.binary()), *batch.columns[:3], pa.array([v.tobytes() for v in raw], pa.binary())],
                names=["key", "id", "label", "anchor", "vector"],
            )

    def blocked(batches):
        from pyspark import TaskContext

        first, nth, held = TaskContext.get().partitionId() << 24, 0, []

        def block(n):
            nonlocal nth, held
            whole = pa.Table.from_batches(held).combine_chunks()
            some, held = whole.slice(0, n), whole.slice(n).to_batches()
            x = shape.unpack(b"".join(some["vector"].to_pylist()))
            labels = some["label"].to_pylist()
            row = (
                first | nth, some["id"].to_pylist(), labels, np.flatnonzero(some["anchor"].to_numpy()).tolist(), shape.pack(x),
                shape.pack(x.min(axis=0)), shape.pack(x.max(axis=0)), labels[0] if len(set(labels)) == 1 else None,
            )
            nth += 1
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=out)

        names = ["block", "ids", "labels", "anchors", "vectors", "low", "high", "one_label"]
        longs = pa.list_(pa.int64())
        kinds = [pa.int64(), longs, longs, pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        out, waiting = pa.schema(list(zip(names, kinds, strict=True))), 0
        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            while waiting >= 1 << BLOCK_BITS:
                yield block(1 << BLOCK_BITS)
                waiting -= 1 << BLOCK_BITS
        if waiting:
            yield block(waiting)

    placed = map_batches(rows, keyed, "key binary, id long, label long, anchor boolean, vector binary").withColumn("tie", F.monotonically_increasing_id())
    ordered = staged(placed).repartitionByRange("key", "id", "tie").sortWithinPartitions("key", "id", "tie")
    return staged(map_batches(ordered.select("id", "label", "anchor", "vector"), blocked, _BLOCKS))


def _longs(values) -> pa.Array:
    return pa.array(values, pa.int64())


def _ids(column: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([0 if i is None else i for i in column], np.int64), np.array([i is None for i in column], bool)


_GROUPS = "group long, rows array<long>, ids array<long>, labels array<long>, vectors binary, extra binary"


def _groups(blocks: DataFrame, shape: Shape, k: int) -> DataFrame:
    """The anchors in groups, each with the score (in ``extra``) that its own block shows its ``k`` positives to reach."""

    def each(batches):
        from pyspark import TaskContext

        first, nth, held = TaskContext.get().partitionId() << 32, 0, []

        def group(some):
            nonlocal nth
            nth += 1
            rows, ids, labels, vectors, floors = zip(*some, strict=True)
            lists = [pa.array([list(x)], pa.list_(t)) for x, t in ((rows, pa.int64()), (ids, pa.int64()), (labels, pa.int64()))]
            return pa.RecordBatch.from_arrays(
                [_longs([first + nth]), *lists, *[pa.array([x], pa.binary()) for x in (b"".join(vectors), np.array(floors, np.float64).tobytes())]],
                names=["group", "rows", "ids", "labels", "vectors", "extra"],
            )

        for batch in batches:
            for block, ids, labels, anchors, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                x, labels = shape.unpack(raw), np.array(labels, np.int64)
                scores = products(x[anchors], x)
                for i, own in zip(anchors, scores, strict=True):
                    same = labels == labels[i]
                    same[i] = False
                    best = np.sort(own[same])[::-1]
                    floor = np.nextafter(float(best[k - 1]), -np.inf) if len(best) >= k else -np.inf
                    held.append((block << BLOCK_BITS | i, ids[i], int(labels[i]), shape.pack(x[i]), floor))
            while len(held) >= GROUP:
                some, held = held[:GROUP], held[GROUP:]
                yield group(some)
        if held:
            yield group(held)

    own = blocks.where(F.size("anchors") > 0).select("block", "ids", "labels", "anchors", "vectors")
    return staged(map_batches(own, each, _GROUPS))


# ---------------------------------------------------------------- which blocks to read


def _pages(blocks: DataFrame) -> DataFrame:
    """Zone maps alone, many in a row."""

    def each(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, PAGE):
                some = batch.slice(i, PAGE)
                lists = [pa.array([some.column(j).to_pylist()], pa.list_(pa.int64())) for j in (0, 1)]
                blobs = [pa.array([b"".join(some.column(j).to_pylist())], pa.binary()) for j in (2, 3)]
                yield pa.RecordBatch.from_arrays([*lists, *blobs], names=["zones", "one_label", "low", "high"])

    schema = "zones array<long>, one_label array<long>, low binary, high binary"
    return staged(map_batches(blocks.select("block", "one_label", "low", "high"), each, schema).withColumn("tile", F.col("zones")[0]))


def _chosen(groups: DataFrame, pages: DataFrame, shape: Shape, wants) -> DataFrame:
    """group, block and the places in the group (``who``) of the anchors that must read the block.

    ``wants(least, most, extra, labels, one_label)`` tells which bounds do. Groups and pages of zone maps
    meet in blocks: each group is sent to every tile of pages once.
    """
    tiles = max(1, pages.count())

    def each(batches):
        for batch in batches:
            for group, raw, labels, extra, zones, one, low, high in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                least, most = bounds(shape.unpack(raw), shape.unpack(low), shape.unpack(high))
                one, none = _ids(one)
                alone = ~none & (one == np.array(labels, np.int64)[:, None])  # blocks of just the anchor's label
                other = ~none & ~alone  # blocks of one other label
                wanted = wants(least, most, extra, alone, other)
                hit = np.flatnonzero(wanted.any(axis=0))
                if len(hit):
                    who = pa.array([np.flatnonzero(wanted[:, j]).tolist() for j in hit], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([_longs([group] * len(hit)), _longs(np.array(zones)[hit]), who], names=["group", "block", "who"])

    tile = F.pmod(F.xxhash64("tile"), F.lit(tiles))
    sent = groups.select("group", "vectors", "labels", "extra", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("tile"))
    met = sent.join(pages.withColumn("tile", tile), "tile").drop("tile")
    return map_batches(met, each, "group long, block long, who array<int>")


_FOUND = "group long, nth int, place int, score long, id long, row long"


def _whole(scores: np.ndarray) -> np.ndarray:
    """As 64-bit integers; larger ones end at the limits."""
    if scores.dtype == object:
        limit = 2**63 - 1
        scores = np.array([max(-limit - 1, min(limit, s)) for s in scores.tolist()], np.int64)
    return scores.astype(np.int64)


def _first(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of each anchor (nth) and place the ``k`` best: by score, the highest first, then by id, the smallest first and null last."""
    nth, place, score, id, lacking, row = found
    order = np.lexsort((row, id, lacking, -score, place, nth))
    nth, place = nth[order], place[order]
    start = np.flatnonzero(np.r_[True, (nth[1:] != nth[:-1]) | (place[1:] != place[:-1])]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return [x[order[rank < k]] for x in found]


def _read(chosen: DataFrame, groups: DataFrame, blocks: DataFrame, shape: Shape, k: int, pick) -> DataFrame:
    """The ``k`` best rows for each anchor and place, of what ``pick`` takes from each block that its group reads.

    A group's blocks are dealt to several tasks; each keeps only the best of what it has read.
    """
    numbers = [F.col(c).alias(f"c_{c}") for c in ("ids", "labels", "vectors")]
    spread = groups.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))))
    met = chosen.join(blocks.select("block", *numbers), "block").withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(SLICES)))
    met = met.join(spread, ["group", "slice"]).select("group", "rows", "labels", "vectors", "extra", "block", "who", *[f"c_{c}" for c in ("ids", "labels", "vectors")])

    def batch_of(group, found):
        nth, place, score, id, lacking, row = _first(found, k)
        return pa.RecordBatch.from_arrays(
            [_longs([group] * len(nth)), pa.array(nth, pa.int32()), pa.array(place, pa.int32()), _longs(score), pa.array(id, pa.int64(), mask=lacking), _longs(row)],
            names=["group", "nth", "place", "score", "id", "row"],
        )

    def each(batches):
        now, kept, held = None, [], 0
        for batch in batches:
            for group, rows, labels, raw, extra, block, who, c_ids, c_labels, c_raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if group != now:
                    if kept:
                        yield batch_of(now, [np.concatenate(x) for x in zip(*kept, strict=True)])
                    now, kept, held = group, [], 0
                ids, lacking = _ids(c_ids)
                c_labels, own = np.array(c_labels, np.int64), np.array(rows, np.int64)[who]
                scores = products(shape.unpack(raw)[who], shape.unpack(c_raw))
                for i, mine, score in zip(who, own, scores, strict=True):
                    for place, at in pick(score, c_labels == labels[i], mine - (block << BLOCK_BITS), extra, i):
                        some = np.full(len(at), i, np.int32), np.full(len(at), place, np.int32), _whole(score[at]), ids[at], lacking[at], at + (block << BLOCK_BITS)
                        kept.append(some)
                        held += len(at)
                if held > 1 << 18:
                    kept = [_first([np.concatenate(x) for x in zip(*kept, strict=True)], k)]
                    held = len(kept[0][0])
        if kept:
            yield batch_of(now, [np.concatenate(x) for x in zip(*kept, strict=True)])

    best = Window.partitionBy("group", "nth", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return map_batches(met, each, _FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


# ---------------------------------------------------------------- positives and windows


def _positives(groups: DataFrame, pages: DataFrame, blocks: DataFrame, shape: Shape, k: int) -> DataFrame:
    def wants(least, most, extra, alone, other):
        return (most >= np.frombuffer(extra)[:, None]) & ~other

    def pick(score, same, own, extra, i):
        same = same.copy()
        if 0 <= own < len(same):
            same[own] = False
        at = np.flatnonzero(same & (score >= np.frombuffer(extra)[i]))
        yield 0, at

    return staged(_read(_chosen(groups, pages, shape, wants), groups, blocks, shape, k, pick))


def _with_windows(groups: DataFrame, positives: DataFrame, k: int) -> DataFrame:
    """The groups with the scores of their positives in ``extra``: ``k`` an anchor, -1 where there is no window."""

    def each(batches):
        for batch in batches:
            extras = []
            for rows, nth, rank, score in zip(*(batch.column(n).to_pylist() for n in ("rows", "nths", "ranks", "scores")), strict=True):
                tops = np.full((len(rows), k), -1, np.int64)
                tops[nth, np.array(rank) - 1] = np.maximum(score, -1)
                extras.append(tops.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(extras, pa.binary())], names=[*batch.schema.names[:5], "extra"])

    lists = positives.groupBy("group").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("nth", "rank", "score")])
    joined = groups.drop("extra").join(lists, "group")
    return staged(map_batches(joined, each, _GROUPS))


def _negatives(groups: DataFrame, pages: DataFrame, blocks: DataFrame, shape: Shape, positives: int, k: int, least: int, most: int) -> DataFrame:
    def tops_of(extra):
        return np.frombuffer(extra, np.int64).reshape(-1, positives)

    def wants(low, high, extra, alone, other):
        wanted = np.zeros(alone.shape, bool)
        for top in tops_of(extra).T:
            top = top.astype(low.dtype)[:, None]
            wanted |= (top >= 0) & (100 * high >= least * top) & (100 * low <= most * top)
        return wanted & ~alone

    def pick(score, same, own, extra, i):
        tops = tops_of(extra)[i].tolist()
        reach = [t for t in tops if t >= 0]
        if not reach:
            return
        at = np.flatnonzero(~same & (100 * score >= least * min(reach)) & (100 * score <= most * max(reach)))
        for place, top in enumerate(tops):
            if top >= 0 and len(at):
                some = 100 * score[at]
                found = at[(some >= least * top) & (some <= most * top)]
                if len(found):
                    yield place + 1, found

    return _read(_chosen(groups, pages, shape, wants), groups, blocks, shape, k, pick)


def mine(
    rows: DataFrame, anchors: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: float = 256.0, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100,
) -> DataFrame:
    """Of each anchor and each of its positives, the negatives whose scores lie in a window below the positive's.

    A component becomes ``floor(scale * x)``; the score of two rows is the inner product. An anchor's positives are
    its ``positives`` best other rows of its label; of the rows of other labels those with ``least`` to ``most``
    percent of the positive's score count, the best ``negatives`` of them. Higher scores come first, then smaller
    ids, null ids last. Rows with a null label, a null vector or a null or non-finite component take no part; shorter
    vectors are filled up with zeros. A positive below zero has no window. Repeated rows, and rows that share an id,
    are rows of their own, as anchors too. ``id`` and ``label`` are integers; other columns are not read. Scores
    beyond 64 bits end at their limits. Empty in, empty out.

    Returns anchor_id, positive_id, rank, negative_id, positive_score and negative_score.
    """
    part = _taking_part(rows, anchors, id, vector, label, scale)
    shape = _shape(part)
    if shape is None:
        nothing = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return rows.sparkSession.createDataFrame([], nothing)
    blocks = _blocks(part, shape)
    pages = _pages(blocks)
    groups = _groups(blocks, shape, positives)
    better = _positives(groups, pages, blocks, shape, positives)
    worse = _negatives(_with_windows(groups, better, positives), pages, blocks, shape, positives, negatives, least, most)
    names = groups.select("group", F.posexplode("ids").alias("nth", "anchor_id"))
    better = better.select("group", "nth", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    worse = worse.select("group", "nth", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return worse.join(better, ["group", "nth", "place"]).join(names, ["group", "nth"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score",
    )
