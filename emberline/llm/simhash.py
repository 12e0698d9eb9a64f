"""SimHash near-duplicates through a vantage-point tree.

A text's fingerprint has 64 bits, each the majority vote of its shingles' hashes. Different
fingerprints are dealt to the leaves of a tree that splits by the Hamming distance to vantage
points. By the triangle inequality two fingerprints within ``radius`` differ by no more in their
distance to a vantage point, so only those just beyond a boundary are copied across it, and
every pair meets in a leaf. Leaves are compared exactly; oversized ones in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.common import col, keep_listed, map_batches, staged
from emberline.llm.components import connected_components
from emberline.llm.exact_dedup import sha256

SEED = 42
#: Fingerprints a leaf is meant to have, and how many are compared in one group at most.
LEAF, BLOCK = 1024, 4096
#: The tree is fitted on a sample: at most so many fingerprints, and one in so many.
SAMPLE, ONE_IN = 1 << 18, 16

# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of all runs of ``shingle`` words, or of all words if they are fewer.

    Words are runs of other than ASCII white space, A-Z in lower case.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    wide = min(shingle, len(words)) - 1
    begins, ends = (ends - size)[: len(words) - wide].tolist(), ends[wide:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, ends, strict=True)), np.uint64, len(ends))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits, the votes of :func:`shingle_hashes`; no word: 0."""
    hashes = shingle_hashes(text, shingle)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        some = hashes[i : i + (1 << 14)]
        votes += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id: str = "doc_id", text: str = "text", copies: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed 64 bits), and with ``copies`` the text's digest."""

    def each(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]], names=["doc_id", "fp", *names])

    names = ["digest"] if copies else []
    narrow = docs.select(col(id).alias("doc_id"), col(text).alias("text"), *[sha256(col(text)).alias(n) for n in names])
    fields = [narrow.schema[0], T.StructField("fp", T.LongType()), *[narrow.schema[n] for n in names]]
    return map_batches(narrow, each, T.StructType(fields))


# ---------------------------------------------------------------- tree


@dataclass(frozen=True)
class Tree:
    """Nodes by number; a leaf has no inside (-1)."""

    vantage: np.ndarray
    reach: np.ndarray
    inside: np.ndarray
    outside: np.ndarray

    def deal(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaves and the numbers of the points in them, copies near boundaries included."""
        who, at, leaves = np.arange(len(points)), np.zeros(len(points), np.int64), []
        while len(who):
            ended = self.inside[at] < 0
            leaves.append((at[ended], who[ended]))
            who, at = who[~ended], at[~ended]
            beyond = np.bitwise_count(points[who] ^ self.vantage[at]).astype(np.int64) - self.reach[at]
            into, out = beyond <= radius, beyond > 0
            who, at = np.concatenate([who[into], who[out]]), np.concatenate([self.inside[at[into]], self.outside[at[out]]])
        return np.concatenate([a for a, _ in leaves]), np.concatenate([w for _, w in leaves])


def fit_tree(sample: np.ndarray, total: int, radius: int, leaf: int = LEAF, tries: int = 6) -> Tree:
    """A tree for ``total`` fingerprints such as ``sample``, with leaves of about ``leaf`` of them.

    Each node takes, of some vantage points and all boundaries, the split with the least pairs to
    compare, copies included. It ends where a split would save little or the sample runs out.
    """
    rng = np.random.default_rng(0)
    vantage, reach, inside, outside = [np.uint64(0)], [0], [-1], [-1]
    waiting = [(0, sample)]
    while waiting:
        node, points = waiting.pop()
        if len(points) < 8 or len(points) / max(1, len(sample)) * total <= leaf:
            continue
        best = (0.9, None, None)
        for v in rng.choice(points, tries):
            spread = np.bincount(np.bitwise_count(points ^ v), minlength=65 + radius) / len(points)
            upto = np.cumsum(spread)
            cost = upto[radius:] ** 2 + (1 - upto[: len(upto) - radius]) ** 2
            if cost.min() < best[0]:
                best = (cost.min(), v, int(cost.argmin()))
        if best[1] is None:
            continue
        vantage[node], reach[node] = best[1], best[2]
        far = np.bitwise_count(points ^ best[1])
        inside[node], outside[node] = len(vantage), len(vantage) + 1
        for child in (points[far <= best[2] + radius], points[far > best[2]]):
            waiting.append((len(vantage), child))
            for table, empty in ((vantage, np.uint64(0)), (reach, 0), (inside, -1), (outside, -1)):
                table.append(empty)
    return Tree(np.array(vantage, np.uint64), np.array(reach), np.array(inside), np.array(outside))


def link_group(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked ``points`` (all different) and, for each, the smallest that it reaches among them.

    Every point is compared once with all that no search has reached before, so this is exact, and
    a dense group costs no more than a sparse one: it is spanned, not listed pair by pair.
    """
    points = np.sort(points)
    left, members, roots = np.arange(len(points)), [], []
    while len(left):
        root, left = left[0], left[1:]
        queue, reached = [root], []
        while queue and len(left):
            near = np.bitwise_count(points[left] ^ points[queue.pop()]) <= radius
            if near.any():
                found = left[near].tolist()
                left = left[~near]
                queue += found
                reached += found
        if reached:
            members += [root, *reached]
            roots += [root] * (len(reached) + 1)
    return points[np.array(members, np.int64)], points[np.array(roots, np.int64)]


def _dealing(tree: Tree, radius: int) -> Callable:
    def each(batches):
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            leaves, who = tree.deal(points, radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(points[who].view(np.int64))], names=["leaf", "fp"])

    return each


def _linking(radius: int) -> Callable:
    def each(group: pa.Table) -> pa.Table:
        points = np.unique(group.column("fp").to_numpy().view(np.uint64))
        a, b = link_group(points, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return each


def links(classes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that span, exactly, all links within ``radius`` bits among the different ``fp`` of ``classes``."""
    total = classes.count()
    share = min(1 / ONE_IN, SAMPLE / max(1, total))
    sample = classes.select("fp").sample(share, 7).toArrow().column(0).to_numpy() if total > LEAF else np.zeros(0, np.int64)
    tree = fit_tree(np.sort(sample).view(np.uint64), total, radius)
    dealt = staged(map_batches(classes.select("fp"), _dealing(tree, radius), "leaf long, fp long"))
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int")
    sizes = dealt.groupBy("leaf").agg(blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # a leaf of one block is one group; else each two blocks meet, which also compares each with itself
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array("own"))
    )
    groups = (
        dealt.join(sizes, "leaf").withColumn("own", own).select("leaf", "own", "fp", F.explode(others).alias("other"))
        .select("leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    return groups.groupBy("leaf", "i", "j").applyInArrow(_linking(radius), "a long, b long")


# ---------------------------------------------------------------- documents


def settle(rows: DataFrame, labels: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """``rows`` (doc_id, fp, ...) with the component_id and label of their component; ``labels`` has the linked ``fp``."""
    if classes is None:
        classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    labels = labels.withColumnRenamed("node", "fp")
    linked = classes.join(labels, "fp")
    smallest = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    named = linked.join(smallest, "label").select("fp", "component_id", "label")
    alone = classes.where("n > 1").join(labels, "fp", "left_anti").select("fp", F.col("first").alias("component_id"), F.col("fp").alias("label"))
    found = staged(named.unionByName(alone)).withColumn("met", F.lit(True))
    # a fingerprint of one row that links to nothing is its own component, and needs no row here
    return rows.join(found, "fp", "left").select(
        *rows.columns, F.when(F.col("met"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("label", "fp").alias("label"),
    )


def join_near(rows: DataFrame, radius: int) -> DataFrame:
    """``rows`` (a stored table: doc_id, fp, ...) with the component_id and label that links within ``radius`` bits give."""
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    edges = staged(links(classes, radius))
    return settle(rows, connected_components(edges), classes)


def _decide(docs: DataFrame, radius: int, shingle: int, id: str, text: str, copies: bool) -> DataFrame:
    return join_near(staged(fingerprints(docs, shingle, id, text, copies)), radius)


def mark_near_copies(docs: DataFrame, radius: int = 2, shingle: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in at most ``radius`` bits link; ``component_id`` is the smallest id that
    links reach (null only if all of them are null). A null text has no words; texts without
    words share fingerprint 0. Repeated rows share a component. Other columns of ``docs``,
    whatever their names, are not read. Empty in, empty out.
    """
    decided = _decide(docs, radius, shingle, id, text, False)
    return decided.select(F.col("doc_id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, decided: DataFrame, id: str, text: str) -> DataFrame:
    """Of each label of ``decided`` (doc_id, digest, component_id, label) one row of ``docs`` with the smallest id."""
    # ids may be null or repeat, so a component goes by its label, a fingerprint
    kept = staged(decided).where("doc_id <=> component_id").groupBy("label").agg(
        F.min(F.struct("doc_id", "digest")).alias("key"), F.count(F.lit(1)).alias("n")
    )
    kept = staged(kept.select("key.doc_id", "key.digest", "n"))
    keys = ["doc_id", "digest"]
    return keep_listed(
        docs, {"doc_id": col(id), "digest": sha256(col(text))}, kept.select(*keys).distinct(), kept.where("n > 1").select(*keys)
    )


def drop_near_copies(docs: DataFrame, radius: int = 2, shingle: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component of :func:`mark_near_copies` one row of ``docs`` with the smallest id, with its own columns."""
    return one_of_each(docs, _decide(docs, radius, shingle, id, text, True), id, text)
