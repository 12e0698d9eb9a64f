"""Vector operators against plain loops over all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import hard_negatives, queries, small_world
from tests.llm.conftest import SF_DIR

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, `block` int, `key.x` int, vector string"


def usable(v, label=0):
    return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def slow_negatives(rows, positives=5, negatives=5):
    """Rows of (vec_id, vector, label) as the contract reads, ids and labels as they are."""
    part = [(i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in rows if usable(v, label)]
    last = lambda i: (i is None, i or 0)
    out = []
    for n, (i, v, label) in enumerate(part):
        if i is None or i % 100:
            continue
        scored = sorted(((-dot(v, w), last(j), m) for m, (j, w, _) in enumerate(part) if m != n))
        same = [(-s, m) for s, _, m in scored if part[m][2] == label][:positives]
        for top, m in same:
            inside = [(-s, k) for s, _, k in scored if part[k][2] != label and 80 * top <= -100 * s <= 100 * top][:negatives]
            out += [(i, part[m][0], rank, part[k][0], top, s) for rank, (s, k) in enumerate(inside, 1)]
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "a", 1, 2, "b") for r in rows], SCHEMA).repartition(parts)


def negatives(spark, rows, tmp_path):
    folder = str(tmp_path)
    frame(spark, rows).write.parquet(f"{folder}/embeddings.parquet")
    got = [tuple(r) for r in queries.op12_hard_negatives(spark, folder).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(slow_negatives(rows), key=key)
    return got


def messy(n, dims=8, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(int(i * 20), [float(x) for x in np.float32(rng.normal(size=dims))], int(rng.integers(3))) for i in range(n)]
    rows += [(i, rows[3][1], 1) for i in range(1, 40)]  # one vector, many ids
    rows += rows[:10]  # repeated rows, anchors among them
    rows += [(100, rows[7][1], 2), (None, rows[5][1], 1), (None, rows[6][1], 0)]
    rows += [(300, None, 1), (400, rows[0][1], None), (500, [float("nan")] * dims, 1), (700, [float("inf")] * dims, 1), (800, [None] * dims, 1)]
    return rows + [(900, [], 1), (1000, [0.0] * dims, 2), (1100, [1.5], 0), (-100, [-1.0] * dims, 1)]


def test_hard_negatives_messy(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_BITS", 4)
    monkeypatch.setattr(hard_negatives, "GROUP", 7)
    monkeypatch.setattr(hard_negatives, "PAGE", 5)
    assert len(negatives(spark, messy(300), tmp_path)) > 100


def test_hard_negatives_beyond_doubles(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i * 50, [float(x) for x in np.float32(rng.normal(size=3) * 4e6)], i % 2) for i in range(40)]
    assert negatives(spark, rows, tmp_path)


def test_hard_negatives_empty(spark, tmp_path):
    assert negatives(spark, [], tmp_path) == []


def test_blocks_that_cannot_matter_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_BITS", 5)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16)) * 3
    rows = [(i, [float(x) for x in centres[i % 20] + rng.normal(size=16) * 0.01], i % 3) for i in range(2000)]
    part = hard_negatives._taking_part(frame(spark, rows), F.col("vec_id") % 100 == 0, "vec_id", "embedding", "label", 256.0)
    shape = hard_negatives._shape(part)
    blocks = hard_negatives._blocks(part, shape)
    groups, pages = hard_negatives._groups(blocks, shape, 5), hard_negatives._pages(blocks)
    chosen = hard_negatives._chosen(groups, pages, shape, lambda least, most, extra, alone, other: (most >= np.frombuffer(extra)[:, None]) & ~other)
    read = chosen.select(F.sum(F.size("who"))).first()[0]
    assert read < 0.5 * 20 * blocks.count()


def slow_nearest(rows, k=10):
    """(query id, rank, id, score) by all distances, for rows of (vec_id, vector)."""
    dims = max((len(v) for _, v in rows if v), default=0)
    part = [(i, np.array([*v, *[0.0] * (dims - len(v))])) for i, v in rows if usable(v) and any(v)]
    out = []
    for n, (i, v) in enumerate(part):
        if i is not None and i % 100 == 0:
            far = sorted((float(np.sqrt(((w - v) ** 2).sum())), j is None, j or 0) for m, (j, w) in enumerate(part) if m != n)
            out += [(i, rank, None if lacking else j, d) for rank, (d, lacking, j) in enumerate(far[:k], 1)]
    return out


def neighbours(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    return [tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in queries.op13_nearest(spark, str(tmp_path)).collect()]


def recall(got, true):
    """Share of the true rows found, those at the distance of the last one exchangeable."""
    got, true = ({(q, i, round(d, 9)) for q, _, i, d in x} for x in (got, true))
    return len(got & true) / len(true)


def test_nearest_messy(spark, tmp_path, monkeypatch):
    """Small shards are searched whole, so the answer is exact, ties and all."""
    monkeypatch.setattr(small_world, "SHARD", 60)
    rows = messy(300)
    got, true = neighbours(spark, rows, tmp_path), slow_nearest([r[:2] for r in rows])
    key = lambda r: (r[0], round(r[3], 9), r[2] is None, r[2] or 0, r[1])
    assert [r[:3] for r in sorted(got, key=key)] == [r[:3] for r in sorted(true, key=key)]
    assert np.allclose([r[3] for r in sorted(got, key=key)], [r[3] for r in sorted(true, key=key)], rtol=1e-12)


def test_nearest_in_rounds(spark, tmp_path, monkeypatch):
    """Queries beyond SENT bytes go to the shards in rounds; no row of a shard is paired with one query by a shuffle."""
    monkeypatch.setattr(small_world, "SHARD", 60)
    monkeypatch.setattr(small_world, "SENT", 200)
    rows = [(i * 50, [float(c) for c in v], 0) for i, v in enumerate(np.float32(np.random.default_rng(9).normal(size=(200, 4))))]
    got, true = neighbours(spark, rows + rows[:20], tmp_path), slow_nearest([r[:2] for r in rows + rows[:20]])
    assert sorted((q, r, i, round(d, 9)) for q, r, i, d in got) == sorted((q, r, i, round(d, 9)) for q, r, i, d in true)


def test_answers_leave_out_the_query_alone():
    """One entry with the query's own id and vector is left out; equal scores go by id, null ids last."""
    x = np.array([[0.0, 0.0], [3.0, 4.0], [1e308, 0.0]])
    owners, ids, lacking = np.array([0, 0, 0, 1, 1, 2]), np.array([7, 7, 0, 7, 0, 5]), np.array([0, 0, 1, 0, 1, 0], bool)
    q, found = np.zeros((2, 2)), np.array([[0, 1, 2, -1], [0, 1, 2, -1]])
    with np.errstate(over="ignore"):
        row, entry, score = small_world._answers(x, owners, ids, lacking, q, np.array([7, 0]), np.array([False, True]), found, 5)
    assert row.tolist() == [0] * 5 + [1] * 5
    assert [(ids[e], bool(lacking[e])) for e in entry[:5]] == [(7, False), (0, True), (7, False), (0, True), (5, False)]
    assert [(ids[e], bool(lacking[e])) for e in entry[5:]] == [(7, False), (7, False), (7, False), (0, True), (5, False)]
    assert score.tolist() == [0, 0, 5, 5, math.inf] * 2


def test_nearest_few_and_none(spark, tmp_path):
    assert neighbours(spark, [], tmp_path / "a") == []
    assert neighbours(spark, [(0, [1.0, 2.0], 1)], tmp_path / "b") == []
    got = neighbours(spark, [(0, [1.0, 2.0], 1), (7, [1e30, 2.0], 1), (5, [1.0, 2.0], 1)], tmp_path / "c")
    assert [r[:3] for r in sorted(got)] == [(0, 1, 5), (0, 2, 7)]


@pytest.mark.parametrize("spread", [1.0, 0.02])
def test_recall_of_the_graph(spark, tmp_path, monkeypatch, spread):
    """At least 0.9 of the true neighbours, in scattered and in tightly grouped vectors, a third of all in one group."""
    monkeypatch.setattr(small_world, "SHARD", 1500)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 32))
    group = np.where(np.arange(6000) % 3 == 0, 0, rng.integers(0, 30, 6000))
    x = np.float32(centres[group] * (1 - spread) + rng.normal(size=(6000, 32)) * spread)
    rows = [(i * 5, [float(c) for c in v], 0) for i, v in enumerate(x)]
    got, true = neighbours(spark, rows, tmp_path), slow_nearest([r[:2] for r in rows])
    assert recall(got, true) >= 0.9


@pytest.mark.parametrize("n", [33 * 16, 40 * 16, 200 * 16])
def test_graph_with_a_large_second_layer(monkeypatch, n):
    """A layer above of more than DENSE nodes is larger than the first part of the one below; its nodes are no entries yet."""
    monkeypatch.setattr(small_world, "DENSE", 32)
    x = np.random.default_rng(6).normal(size=(n, 16)).astype(np.float32)
    graph = small_world.build_graph(x)
    assert small_world.sizes(n)[1] > 32 and all((links < len(links)).all() for links in graph.layers)
    found = graph.search(x[:200])[:, :11]
    true = np.argsort(((x[:200, None] - x) ** 2).sum(axis=2), axis=1)[:, :11]
    assert sum(len({*a} & {*b}) for a, b in zip(found.tolist(), true.tolist(), strict=True)) >= 0.99 * 200 * 11


def test_given_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    got = [tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in queries.op13_nearest(spark, SF_DIR).collect()]
    assert recall(got, slow_nearest(rows)) >= 0.99


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (5, 2)])
def test_curve_visits_neighbours(dims, bits):
    """All cells of a grid in the order of the curve: each step moves by one in one dimension."""
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = [k.tobytes() for k in hard_negatives.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
