"""Near copies by the share of equal shingles.

Two texts are near copies when the sets of their shingles (runs of five words) have a Jaccard
similarity of at least 0.8. MinHash bands find the candidates. A first round compares one leader of
each bucket of a few bands with the other members, which unites most groups of near copies at a few
links a member. In the second all bands take part: the members of a bucket that are not united yet
meet in blocks, where pairs that agree in size and in two bits of most minima are compared exactly.
Pairs are never rows: a block returns only the links that unite its members.

:func:`drop_near_or_similar` begins with the SimHash links of :mod:`emberline.llm.simhash`: what they
unite counts as one, and the rounds above only look for what lies further apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.common import col, map_batches, ship_package, staged
from emberline.llm.components import connected_components
from emberline.llm.exact_dedup import sha256
from emberline.llm.simhash import fingerprint, join_near, one_of_each, settle, shingle_hashes

SEED = 42
#: A pair of similarity s shares no band, and so is missed, with probability (1 - s**DEPTH) ** BANDS: 1.3e-7 at 0.8.
BANDS, DEPTH = 40, 5
#: Bands of the first round.
FIRST = 4
#: Rows and shingles of a block, about.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 1 << 21
#: Two bits of each minimum differ with probability 0.75 (1 - s). At 0.8 more than so many do with probability 3.4e-9.
DIFFERENT = 62
#: Bytes of those bits in eights, and a mask of every second bit.
_WORDS, _PAIRS = -(-BANDS * DEPTH * 2 // 64), 0x5555555555555555
#: Rows of which the numbers are sent to all tasks; more meet their texts in a shuffle.
MAX_SENT = 250_000
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 64, (BANDS * DEPTH, 1), np.uint64) | np.uint64(1)
_MIX = _RNG.integers(0, 1 << 64, (BANDS, DEPTH), np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The different hashes of the shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    return np.unique(shingle_hashes(text, shingle))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One key a band, equal where the ``DEPTH`` minima of a band are; and two bits of each minimum, in some integers."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(_WORDS, np.int64)
    least = np.full(BANDS * DEPTH, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (_FACTORS * hashes[i : i + 1024]).min(axis=1), out=least)
    bits = np.zeros((_WORDS * 32, 2), np.uint8)
    bits[: len(least)] = (least[:, None] >> np.array([20, 21], np.uint64)) & np.uint64(1)
    return (least.reshape(BANDS, DEPTH) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64), np.packbits(bits).view(np.int64)


#: The number of all rows without words.
_WORDLESS = -1


def _sketches(docs: DataFrame, shingle: int, id: str, text: str, voters: int | None = None) -> DataFrame:
    """One stored row per row of ``docs``: doc_id, text and its digest, a number (``fp``), and of the shingle set the size, bits and band keys.

    A number is a row's own, so no hash stands for a text; only rows without words share one. With
    ``voters`` also ``print``, the SimHash fingerprint of shingles of so many words.
    """

    def each(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(2).to_pylist()]
            keys, bits = zip(*[sketch(s) for s in sets], strict=True) if sets else ((), ())
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (bits, keys)]
            names = ["doc_id", "digest", "text", "size", "bits", "keys"]
            if voters is not None:
                prints = np.array([fingerprint(t, voters) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
                lists, names = [*lists, pa.array(prints)], [*names, "print"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(s) for s in sets], pa.int32()), *lists], names=names)

    narrow = docs.select(col(id).alias("doc_id"), sha256(col(text)).alias("digest"), col(text).alias("text"))
    found = "size int, bits array<long>, keys array<long>" + (", print long" if voters is not None else "")
    rows = map_batches(narrow, each, T.StructType([*narrow.schema, *T.StructType.fromDDL(found)]))
    number = F.monotonically_increasing_id()
    return staged(rows.withColumn("fp", F.when(F.col("size") == 0, F.lit(_WORDLESS).cast("long")).otherwise(number)))


def _sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """fp and shingles of the ``wanted`` rows, stored."""

    def each(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sets = [shingle_set(t, shingle).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "shingles"])

    wanted = staged(wanted)
    few = wanted.count() <= MAX_SENT
    return staged(map_batches(rows.select("fp", "text").join(F.broadcast(wanted) if few else wanted, "fp", "left_semi"), each, "fp long, shingles array<long>"))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those ``pairs`` (a, b, ...) whose shingle sets are similar."""
    left = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))
    both, n = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return pairs.join(left, "a").join(right, "b").where(both / (n - both) >= F.lit(similarity)).select(*pairs.columns)


_MEMBER = ("fp", "size", "bits")


def _open(members: DataFrame) -> DataFrame:
    """The members of buckets that hold several labels, stored."""
    several = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return staged(members.join(several, "key", "left_semi"))


def _alike(size, other, similarity: float):
    return F.least(size, other) / F.greatest(size, other) >= F.lit(similarity)


def _led(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of the leader of each bucket, its smallest number, and a member of another label that may be similar."""
    led = members.groupBy("key").agg(F.min(F.struct(*_MEMBER, "label")).alias("led")).select(F.col("key").alias("led_key"), *[F.col(f"led.{c}").alias(f"led_{c}") for c in (*_MEMBER, "label")])
    words = [F.col("bits")[i].bitwiseXOR(F.col("led_bits")[i]) for i in range(_WORDS)]
    unlike = sum((F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(_PAIRS)) for x in words), F.lit(0))
    met = members.join(led, (F.col("key") == F.col("led_key")) & (F.col("label") != F.col("led_label")) & _alike("size", "led_size", similarity) & (unlike <= DIFFERENT))
    return met.select(F.col("fp").alias("a"), F.col("led_fp").alias("b")).distinct()


def _blocks(members: DataFrame) -> DataFrame:
    """``members`` with the groups (side, i, j) in which they meet all members of their bucket that have another label.

    The members of a bucket's most frequent label need not meet each other: they are side 1, and meet the others
    in pairs of blocks (i of them, j of the others). The others also meet among themselves: side 0, i <= j.
    """
    def blocks(rows, shingles):
        return F.ceil(F.greatest(rows / BLOCK_ROWS, shingles / BLOCK_SHINGLES)).cast("int")

    per = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    top = F.max(F.struct("n", "s", F.col("label").alias("main")))
    sums = per.groupBy("key").agg(top.alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s")).select(
        "key", "top.main", blocks(F.col("top.n"), F.col("top.s")).alias("mains"), (F.col("n") - F.col("top.n")).alias("rest"),
        blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("others"),
    )
    is_main = F.col("label") == F.col("main")
    own = F.pmod(F.xxhash64("fp"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")

    def meet(side, i, j):
        return F.struct(F.lit(side).alias("side"), i.alias("i"), j.alias("j"))

    upto = lambda n: F.sequence(F.lit(0), n - 1)
    as_main = F.transform(upto(F.col("others")), lambda j: meet(1, F.col("own"), j))
    beside = F.transform(upto(F.col("mains")), lambda i: meet(1, i, F.col("own")))
    among = F.when(F.col("rest") > 1, F.transform(upto(F.col("others")), lambda x: meet(0, F.least("own", x), F.greatest("own", x))))
    groups = F.when(F.col("is_main"), as_main).otherwise(F.concat(beside, F.coalesce(among, F.array_except(beside, beside))))
    placed = members.join(sums, "key").withColumns({"own": own, "is_main": is_main})
    return placed.select(*members.columns, "own", "is_main", F.inline(groups))


def _linked(similarity: float):
    """Links that unite the similar rows of a block, each pair in the first band that it shares."""

    def each(group: pa.Table) -> pa.Table:
        fp, label, size, band = (group.column(c).to_numpy() for c in ("fp", "label", "size", "band"))
        bits, keys = (np.array(group.column(c).to_pylist(), np.int64) for c in ("bits", "keys"))
        own, is_main, side, first = (group.column(c).to_numpy() for c in ("own", "is_main", "side", "i"))
        sets, bits = group.column("shingles"), bits.view(np.uint64)
        one_block = bool(side[0] == 0 and (own == own[0]).all())
        part = is_main if side[0] == 1 else own == first
        above = list(range(len(fp)))

        def root(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        known, out = {}, []

        def shingles(x: int) -> np.ndarray:
            if x not in known:
                known[x] = sets[x].values.to_numpy()
            return known[x]

        mask, before = np.uint64(_PAIRS), int(band[0])
        for x in range(len(fp) - 1):
            rest = slice(x + 1, None)
            unlike = bits[rest] ^ bits[x]
            near = np.bitwise_count((unlike | unlike >> np.uint64(1)) & mask).sum(axis=1) <= DIFFERENT
            near &= (label[rest] != label[x]) & (np.minimum(size[rest], size[x]) / np.maximum(size[rest], size[x]) >= similarity)
            if not one_block:
                near &= part[rest] != part[x]
            if before:
                near[near] = ~(keys[rest][near][:, :before] == keys[x, :before]).any(axis=1)
            for y in (np.flatnonzero(near) + x + 1).tolist():
                a, b = root(x), root(y)
                if a != b:
                    both = len(np.intersect1d(shingles(x), shingles(y), assume_unique=True))
                    if both / (int(size[x]) + int(size[y]) - both) >= similarity:
                        above[max(a, b)] = min(a, b)
                        out.append((int(label[x]), int(label[y])))
        columns = list(zip(*out, strict=True)) or [(), ()]
        return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})

    return each


def near_links(rows: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b), stored, from rows to the smallest row that links of their ``print`` within ``radius`` bits reach."""
    met = join_near(rows.select(F.col("fp").alias("doc_id"), F.col("print").alias("fp")), radius)
    return staged(met.where("doc_id != component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))


def _named(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The ``rows`` with words and their ``known`` label (fp, label), else their own number."""
    return rows.where("size > 0").join(known, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def similar_labels(rows: DataFrame, similarity: float, shingle: int, near: DataFrame) -> DataFrame:
    """``node`` and ``label`` of the rows that links reach: those ``near``, and those that share a bucket and are similar.

    ``near`` has an edge (a, b) from a row to the smallest of its group. In the second round the graph has
    one node for all that the first has united.
    """
    ship_package(rows.sparkSession)
    some = _named(rows, near.select(F.col("a").alias("fp"), F.col("b").alias("label")))
    members = _open(some.select(*_MEMBER, "label", F.explode(F.slice("keys", 1, FIRST)).alias("key")))
    pairs = staged(_led(members, similarity))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    labels = connected_components(_similar(pairs, _sets(rows, wanted, shingle), similarity).unionByName(near))
    named = _named(rows, labels.select(F.col("node").alias("fp"), "label"))
    # buckets are settled on narrow rows; what a comparison needs joins those that are left
    left = _open(named.select("fp", "size", "label", F.posexplode("keys").alias("band", "key")))
    sets = _sets(rows, left.select("fp").distinct(), shingle)
    payload = rows.select("fp", "bits", "keys").join(sets, "fp")
    groups = _blocks(left).join(payload, "fp").groupBy("key", "side", "i", "j")
    merged = connected_components(groups.applyInArrow(_linked(similarity), "a long, b long"))
    names = merged.select(F.col("node").alias("label"), F.col("label").alias("now"))
    moved = labels.join(names, "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    return staged(moved.unionByName(merged.join(labels, "node", "left_anti")))


def drop_similar(
    docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Of each group of near copies one row of ``docs`` with the smallest id, with its own columns.

    Words are those of :func:`simhash.fingerprint`. Links chain; texts without words are near copies of each
    other. Null and repeated ids do not link. Empty in, empty out.
    """
    rows = _sketches(docs, shingle, id, text)
    none = rows.where("false").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    return _one_of_each_label(docs, rows, similar_labels(rows, similarity, shingle, none), id, text)


def drop_near_or_similar(
    docs: DataFrame, radius: int = 2, voters: int = 3, similarity: float = 0.8, shingle: int = 5, id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Of each group of near copies one row of ``docs`` with the smallest id, with its own columns.

    Texts link as in :func:`simhash.drop_near_copies`, by fingerprints of ``voters`` words that differ in at most
    ``radius`` bits, or as in :func:`drop_similar`, however far their fingerprints are apart. Links of both kinds chain.
    """
    rows = _sketches(docs, shingle, id, text, voters)
    labels = similar_labels(rows, similarity, shingle, near_links(rows, radius))
    return _one_of_each_label(docs, rows, labels, id, text)


def _one_of_each_label(docs: DataFrame, rows: DataFrame, labels: DataFrame, id: str, text: str) -> DataFrame:
    return one_of_each(docs, settle(rows.select("doc_id", "digest", "fp"), labels), id, text)
