"""Approximate nearest neighbours: a hierarchical small-world graph per shard, results merged.

Different vectors are dealt to shards by hash. A shard's graph has layers, each a random part of the
one below; a node's neighbours in a layer are a row of one flat array. Layers are built from the top,
in batches: a batch descends through the finished layers, searches the layer as it stands, and takes as
neighbours those candidates that are nearer to it than to a neighbour taken before, then the next
nearest. All beams of a batch move in step, so the work is in array operations. A stored shard is one
row; every query is searched in every shard and the nearest of all are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import col, map_batches, staged

#: Different vectors of a shard, queries searched together, and bytes of queries handed to all shards at once.
SHARD, BATCH, SENT = 4096, 512, 32 << 20
#: Neighbours in an upper layer (twice as many in the lowest), width of the beam when building and when searching.
LINKS, BUILD, SEARCH = 16, 64, 128
#: One node in LINKS goes on to the next layer; a layer of so few is linked by all distances.
DENSE = 256
#: Nodes a beam expands at once, and entries it takes over from the layer above.
STRIDE, ENTRIES = 4, 8

# ---------------------------------------------------------------- one graph


def _distances(x: np.ndarray, who: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of row i of ``q`` to the vectors that row i of ``who`` lists; -1 is infinitely far."""
    gap = x[who] - q[:, None, :]
    return np.where(who < 0, np.inf, np.einsum("bmd,bmd->bm", gap, gap))


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``q`` up to ``width`` nearest nodes found (-1: none) and their squared distances, nearest first."""
    n, size = len(q), links.shape[1]
    seen = np.zeros((n, len(x) + 1), bool)  # the last column stands for no node
    seen[:, -1] = True
    ids = np.full((n, width), -1, np.int32)
    far = np.full((n, width), np.inf, np.float32)
    start = entries[:, :width]
    ids[:, : start.shape[1]], far[:, : start.shape[1]] = start, _distances(x, start, q)
    seen[np.arange(n)[:, None], start] = True
    shut = ids < 0
    rows = np.arange(n)
    while len(rows):
        todo = np.where(shut[rows], np.inf, far[rows])
        some = min(STRIDE, width)
        best = np.argpartition(todo, some - 1, axis=1)[:, :some] if some < width else np.argsort(todo, axis=1)
        left = np.isfinite(np.take_along_axis(todo, best, axis=1))
        going = left.any(axis=1)
        rows, best, left = rows[going], best[going], left[going]
        if not len(rows):
            break
        at = rows[:, None]
        shut[at, best] = True
        near = links[ids[at, best]].reshape(len(rows), -1)
        near = np.where(np.repeat(left, size, axis=1), near, -1)
        near = np.where(seen[at, near], -1, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1  # two expanded nodes may share a neighbour
        seen[at, near] = True
        more = _distances(x, near, q[rows]).astype(np.float32)
        all_far, all_ids = np.concatenate([far[rows], more], axis=1), np.concatenate([ids[rows], near], axis=1)
        all_shut = np.concatenate([shut[rows], near < 0], axis=1)
        keep = np.argpartition(all_far, width - 1, axis=1)[:, :width]
        far[rows], ids[rows], shut[rows] = (np.take_along_axis(a, keep, axis=1) for a in (all_far, all_ids, all_shut))
    order = np.lexsort((ids, far), axis=1)
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)


def _selected(x: np.ndarray, who: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Of the candidates in each row, nearest first: those nearer to the node than to one taken before, then the next nearest."""
    n, size = who.shape
    near = x[who]
    square = np.einsum("bmd,bmd->bm", near, near)
    between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(near, near.transpose(0, 2, 1))
    closest, taken, count = np.full((n, size), np.inf, x.dtype), np.zeros((n, size), bool), np.zeros(n, np.int64)
    for j in range(size):
        take = (who[:, j] >= 0) & (far[:, j] < closest[:, j]) & (count < most)
        taken[:, j] = take
        count += take
        closest = np.where(take[:, None], np.minimum(closest, between[:, j]), closest)
    rank = np.where(taken, 0, np.where(who >= 0, 1, 2)) * size + np.arange(size)
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(who, order, axis=1)
    return np.pad(out, ((0, 0), (0, max(0, most - out.shape[1]))), constant_values=-1)


def _ordered(nodes: np.ndarray, who: np.ndarray, far: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (node, candidate, distance) as rows of different candidates, nearest first, ``most`` at most."""
    order = np.lexsort((who, far, nodes))
    nodes, who, far = nodes[order], who[order], far[order]
    fresh = np.r_[True, (nodes[1:] != nodes[:-1]) | (who[1:] != who[:-1])]
    nodes, who, far = nodes[fresh], who[fresh], far[fresh]
    start = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
    rank = np.arange(len(nodes)) - np.repeat(start, np.diff(np.r_[start, len(nodes)]))
    ok, row = rank < most, np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(nodes)]))
    ids, dist = np.full((len(start), most), -1, np.int32), np.full((len(start), most), np.inf, np.float32)
    ids[row[ok], rank[ok]], dist[row[ok], rank[ok]] = who[ok], far[ok]
    return nodes[start], ids, dist


def _known(entries: np.ndarray, n: int) -> np.ndarray:
    """The entries among the first ``n`` nodes, -1 for others; the first nodes for a row without any.

    A layer above of more than DENSE nodes has some that are not yet in the layer being built.
    """
    known = np.where(entries < n, entries, -1)
    none, some = (known < 0).all(axis=1), min(ENTRIES, n, known.shape[1])
    known[none, :some] = np.arange(some)
    return known


def _layer(x: np.ndarray, most: int, entries) -> np.ndarray:
    """Neighbours of every row of ``x``, ``most`` at most; ``entries(a, b)`` gives rows a to b nodes to start from."""
    n = len(x)
    links = np.full((n, most), -1, np.int32)
    dense = min(n, DENSE)
    if dense > 1:
        flat = x[:dense]
        square = (flat * flat).sum(axis=1)
        far = np.maximum(0, square[:, None] + square - 2 * flat @ flat.T).astype(np.float32)
        np.fill_diagonal(far, np.inf)
        order = np.argsort(far, axis=1)[:, : min(dense - 1, BUILD)].astype(np.int32)
        links[:dense] = _selected(x, order, np.take_along_axis(far, order, axis=1), most)
    at = dense
    while at < n:
        end = min(n, at + min(BATCH, at))
        q = x[at:end]
        ids, far = beam(x[:at], links[:at], q, _known(entries(at, end), at), BUILD)
        square = (q * q).sum(axis=1)
        own = np.maximum(0, square[:, None] + square - 2 * q @ q.T).astype(np.float32)
        np.fill_diagonal(own, np.inf)
        twins = np.argsort(own, axis=1)[:, : min(LINKS, len(q) - 1)]
        ids = np.concatenate([ids, (twins + at).astype(np.int32)], axis=1)
        far = np.concatenate([far, np.take_along_axis(own, twins, axis=1)], axis=1)
        order = np.argsort(far, axis=1)[:, :BUILD]
        ids, far = np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)
        links[at:end] = _selected(x, ids, far, most)
        # each new node becomes a candidate of its neighbours, which choose again
        new = np.repeat(np.arange(at, end), most)
        to = links[at:end].ravel()
        new, to = new[to >= 0], to[to >= 0]
        known = np.unique(to)
        was = np.repeat(known, most)
        old = links[known].ravel()
        was, old = was[old >= 0], old[old >= 0]
        nodes, who = np.concatenate([to, was]), np.concatenate([new, old])
        gap = x[nodes] - x[who]
        nodes, ids, far = _ordered(nodes, who, np.einsum("nd,nd->n", gap, gap).astype(np.float32), 2 * most)
        links[nodes] = _selected(x, ids, far, most)
        at = end
    return links


@dataclass(frozen=True)
class Graph:
    """Vectors in the order of their layers, the topmost first, and the neighbours in each layer, the lowest first."""

    x: np.ndarray
    layers: list[np.ndarray]

    def search(self, q: np.ndarray, width: int = SEARCH, down_to: int = 0) -> np.ndarray:
        """Nodes near each row of ``q``, nearest first, -1 beyond the last."""
        top = len(self.layers) - 1
        ids = np.tile(np.arange(min(ENTRIES, len(self.layers[top])), dtype=np.int32), (len(q), 1))
        for level in range(top, down_to - 1, -1):
            links = self.layers[level]
            ids, _ = beam(self.x[: len(links)], links, q, ids[:, :ENTRIES], width if level == down_to else 2 * ENTRIES)
        return ids


def sizes(n: int) -> list[int]:
    """Nodes in each layer, the lowest first."""
    out = [n]
    while out[-1] > DENSE:
        out.append(out[-1] // LINKS)
    return out


def build_graph(x: np.ndarray) -> Graph:
    """A graph over the rows of ``x``, whose order must be random: the first ones form the upper layers."""
    x, layers = np.ascontiguousarray(x, np.float32), []
    for level, n in reversed(list(enumerate(sizes(len(x))))):
        above = Graph(x, layers)

        def entries(a, b, above=above):
            return above.search(x[a:b], 2 * ENTRIES) if above.layers else np.zeros((b - a, 1), np.int32)

        layers = [_layer(x[:n], LINKS * (2 if level == 0 else 1), entries), *layers]
    return Graph(x, layers)


# ---------------------------------------------------------------- shards


def _taking_part(rows: DataFrame, queries: Column, id: str, vector: str) -> DataFrame:
    """id, ``query`` and the vector in doubles; a zero of either sign is the same."""
    whole = F.transform(col(vector), lambda x: x.cast("double") + F.lit(0.0))
    named = rows.select(col(id).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("query"), whole.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return named.where(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def _doubles(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


_SHARD = "shard long, vectors binary, owners array<int>, ids array<long>, layers array<binary>"


def build_index(rows: DataFrame, width: int, k: int, scale: float = 1.0, shard: int = SHARD) -> DataFrame:
    """One row a shard: its vectors, the ids that share each (``owners`` and ``ids``), and the flat neighbour arrays.

    ``rows`` have ``id`` and ``vector`` of ``width`` components; graphs are in single precision, of vectors divided by
    ``scale``. All vectors are indexed. Of rows with the same vector
    only those with the ``k + 1`` smallest ids are listed: no other can be among the ``k`` nearest of any row.
    """
    first = Window.partitionBy("vector").orderBy(F.asc_nulls_last("id"))
    listed = staged(rows.select("id", "vector").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1))
    shards = max(1, -(-listed.where("nth = 1").count() // shard))
    numbered = listed.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards))).withColumn("place", F.xxhash64("vector", F.lit(1)))

    def each(batches: Iterator[pa.RecordBatch]):
        now, held = None, []

        def built():
            whole = pa.Table.from_batches(held).combine_chunks()
            x = _doubles(whole["vector"].combine_chunks(), width)
            fresh = np.r_[True, (x[1:] != x[:-1]).any(axis=1)]
            graph = build_graph(x[fresh] / scale)
            owners, ids = (np.cumsum(fresh) - 1).tolist(), whole["id"].to_pylist()
            row = {"shard": now, "vectors": x[fresh].tobytes(), "owners": owners, "ids": ids, "layers": [g.tobytes() for g in graph.layers]}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema(
            [("shard", pa.int64()), ("vectors", pa.binary()), ("owners", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("layers", pa.list_(pa.binary()))]
        )
        for batch in batches:
            at = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a and at[a] != now:
                    if held:
                        yield built()
                    now, held = int(at[a]), []
                held.append(batch.slice(a, b - a))
        if held:
            yield built()

    dealt = numbered.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "place", "vector", "nth")
    return staged(map_batches(dealt.select("shard", "id", "vector"), each, _SHARD))


def _batches(queries: DataFrame, width: int) -> DataFrame:
    """The queries in stored batches: their numbers, ids and vectors."""

    def each(batches):
        from pyspark import TaskContext

        first, nth = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                some = batch.slice(a, BATCH)
                numbers = list(range(first + nth, first + nth + some.num_rows))
                nth += some.num_rows
                lists = [pa.array([x], pa.list_(pa.int64())) for x in (numbers, some.column(0).to_pylist())]
                raw = pa.array([_doubles(some.column(1), width).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([*lists, raw], names=["numbers", "ids", "vectors"])

    return staged(map_batches(queries.select("id", "vector"), each, "numbers array<long>, ids array<long>, vectors binary"))


def _answers(x: np.ndarray, owners: np.ndarray, ids: np.ndarray, lacking: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_lacking: np.ndarray, found: np.ndarray, k: int):
    """Row of ``q``, entry of ``ids`` and score of the ``k`` nearest entries of the nodes ``found`` for each, itself left out."""
    score = np.where(found < 0, np.inf, np.sqrt(((x[found] - q[:, None]) ** 2).sum(axis=2)))
    # a node has an entry or more, of which one can be the query itself where the score is zero
    most = min(k + int((score == 0).sum(axis=1).max(initial=0)), found.shape[1])
    row, at = np.nonzero((found >= 0) & (score <= np.partition(score, most - 1, axis=1)[:, most - 1, None]))
    node, score = found[row, at], score[row, at]
    start = np.searchsorted(owners, np.arange(len(x) + 1))
    count = start[node + 1] - start[node]
    pair = np.repeat(np.arange(len(node)), count)
    entry = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + start[node][pair]
    row, score = row[pair], score[pair]
    itself = (score == 0) & (lacking[entry] == q_lacking[row]) & (ids[entry] == q_ids[row])
    itself[1:] &= ~(itself[:-1] & (pair[1:] == pair[:-1]))  # equal ids of a node stand together; one of them is the query
    row, entry, score = row[~itself], entry[~itself], score[~itself]
    order = np.lexsort((ids[entry], lacking[entry], score, row))
    row, entry, score = row[order], entry[order], score[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[best], entry[best], score[best]


def _numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers with 0 for null, and which are null."""
    return values.fill_null(0).to_numpy(zero_copy_only=False), values.is_null().to_numpy(zero_copy_only=False)


def search_index(index: DataFrame, queries: DataFrame, width: int, k: int, scale: float = 1.0, beam_width: int = SEARCH) -> DataFrame:
    """The ``k`` nearest of each query found: number (of the query), query_id, rank, id and score (Euclidean distance).

    Every shard sees every query once, in a batch, and answers with its own ``k`` nearest. Shards are searched where they
    are read; the queries go to them, SENT bytes in a round, so neither is written again for each of the other. A query
    that is itself indexed does not find itself.
    """
    sent = _batches(queries, width).withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"})
    rounds = max(1, -(-(sent.agg(F.sum(F.octet_length("q_vectors"))).first()[0] or 0) // SENT))

    def each(groups):
        for group in groups:
            columns = [group.column(name) for name in ("numbers", "q_ids", "q_vectors", "vectors", "owners", "ids", "layers")]
            for numbers, q_ids, q_raw, raw, owners, ids, layers in zip(*columns, strict=True):
                q, x = (np.frombuffer(r.as_buffer(), np.float64).reshape(-1, width) for r in (q_raw, raw))
                n = sizes(len(x))
                graph = Graph((x / scale).astype(np.float32), [np.frombuffer(g.as_buffer(), np.int32).reshape(m, -1) for g, m in zip(layers, n, strict=True)])
                found = graph.search((q / scale).astype(np.float32), max(beam_width, k + 1))
                row, entry, score = _answers(x, owners.values.to_numpy(), *_numbers(ids.values), q, *_numbers(q_ids.values), found, k)
                arrays = [numbers.values.take(pa.array(row)), q_ids.values.take(pa.array(row)), ids.values.take(pa.array(entry)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(arrays, names=["number", "query_id", "id", "score"])

    nearest = Window.partitionBy("number").orderBy("score", F.asc_nulls_last("id"))
    found = []
    for n in range(rounds):
        asked = index.drop("shard").crossJoin(F.broadcast(sent.where(F.pmod(F.xxhash64("numbers"), F.lit(rounds)) == n)))
        each_k = map_batches(asked, each, "number long, query_id long, id long, score double")
        best = each_k.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("number", "query_id", "rank", "id", "score")
        found.append(best if rounds == 1 else staged(best))
    return reduce(DataFrame.union, found)


def nearest(rows: DataFrame, queries: Column, id: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, rank, id and score of the ``k`` rows found nearest to each row where ``queries`` holds, itself left out.

    Rows with a null or zero vector, or a null or non-finite component, take no part; shorter vectors are filled up with
    zeros. Ties go to the smaller id, null ids last. Repeated rows are rows of their own, so each has its answer and finds
    the others. Other columns are not read. Empty in, empty out. Scores are exact; the search is approximate.
    """
    part = _taking_part(rows, queries, id, vector)
    width, large = part.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    if width is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    filled = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vector")))
    part = part.withColumn("vector", F.when(F.size("vector") < width, filled).otherwise(F.col("vector")))
    index = build_index(part, width, k, large)
    return search_index(index, part.where("query"), width, k, large).drop("number")
