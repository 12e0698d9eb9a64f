"""Exact duplicates with a heavy-hitter split.

A Misra-Gries summary of each partition finds the digests that may be frequent. Their exact
winners are few, by proof, so they are broadcast and large groups of copies are settled on the
map side. All other digests have small groups and meet in an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import col, keep_listed, map_batches, staged

#: Counters of a summary. At most so many digests are ever broadcast.
COUNTERS = 256


def _summarise(counters: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def each(batches):
        kept: dict[str, int] = {}
        for batch in batches:
            for pair in pc.value_counts(batch.column(0)).to_pylist():
                kept[pair["values"]] = kept.get(pair["values"], 0) + pair["counts"]
            if len(kept) > counters:
                cut = sorted(kept.values(), reverse=True)[counters]
                kept = {digest: n - cut for digest, n in kept.items() if n > cut}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["digest", "seen"]
        )

    return each


def frequent(rows: DataFrame, digest: str, counters: int = COUNTERS) -> DataFrame:
    """Digests that may be frequent: at most ``counters + 1``, whatever the data.

    A partition of n rows undercounts a digest by n / (counters + 1) at most, so a digest with
    over 2N / (counters + 1) of all N rows keeps N / (counters + 1) in the sum. Sums never
    exceed N together, so no more than ``counters + 1`` digests reach that.
    """
    least = rows.count() / (counters + 1)
    parts = map_batches(rows.select(col(digest)), _summarise(counters), "digest string, seen long")
    return parts.groupBy("digest").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= F.lit(least)).select("digest")


def sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def with_winner(rows: DataFrame, group: str, rank: Column, counters: int = COUNTERS) -> DataFrame:
    """``rows`` (a stored table) with ``winner``, the largest ``rank`` of its ``group``, and ``group_size``.

    Frequent groups are settled on the map side from broadcast winners; only the others, each
    a small share of the rows, are shuffled.
    """
    winner, size = F.max(rank), F.count(F.lit(1))
    hot = F.broadcast(frequent(rows, group, counters).withColumnRenamed("digest", group))
    winners = F.broadcast(
        staged(rows.join(hot, group, "left_semi").groupBy(group).agg(winner.alias("winner"), size.alias("group_size")))
    )
    same = Window.partitionBy(group)
    rare = rows.join(winners, group, "left_anti").select("*", winner.over(same).alias("winner"), size.over(same).alias("group_size"))
    return rows.join(winners, group).select(*rare.columns).unionByName(rare)


def _decide(docs: DataFrame, id: str, text: str, normalise: Callable[[Column], Column], counters: int) -> DataFrame:
    rows = staged(
        docs.select(
            col(id).alias("doc_id"), sha256(normalise(col(text))).alias("digest"), F.monotonically_increasing_id().alias("nth")
        )
    )
    return with_winner(rows, "digest", F.struct("doc_id", "nth"), counters).select(
        "doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size",
        (F.col("winner.nth") == F.col("nth")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def mark_copies(
    docs: DataFrame, id: str = "doc_id", text: str = "text",
    normalise: Callable[[Column], Column] = lambda t: t, counters: int = COUNTERS,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after ``normalise`` (nothing, by default); null counts
    as empty. The row with the largest id stays; a null id is the smallest. Of repeated rows with
    that id exactly one stays. Other columns of ``docs``, whatever their names, are not read.
    Empty in, empty out.
    """
    return _decide(docs, id, text, normalise, counters).withColumnRenamed("doc_id", id)


def drop_copies(
    docs: DataFrame, id: str = "doc_id", text: str = "text",
    normalise: Callable[[Column], Column] = lambda t: t, counters: int = COUNTERS,
) -> DataFrame:
    """The rows of ``docs`` that :func:`mark_copies` keeps, with their own columns."""
    decided = staged(_decide(docs, id, text, normalise, counters))
    listed = decided.where("kept").select("doc_id", "text_sha256")
    twins = decided.where("not kept and doc_id <=> keep_id").select("doc_id", "text_sha256").distinct()
    return keep_listed(docs, {"doc_id": col(id), "text_sha256": sha256(normalise(col(text)))}, listed, twins)
