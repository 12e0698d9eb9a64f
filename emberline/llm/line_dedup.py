"""Repeated runs of lines, found by winnowing, in DataFrame expressions only.

A window is the shortest run of lines from some line on that has ``min_words`` words. Each window
selects its smallest line hash as a fingerprint, so two documents that share a run of that many words
share a fingerprint too. Fingerprints met at one position only are dropped; around the others the
windows are compared in full. Windows that occurred before are united, which extends every match
both ways as far as it goes, and the lines of such later runs are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import col, staged

#: Words that a repeated run must have.
MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
NAME = ["doc_id", "body"]


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _named(docs: DataFrame, id: str, text: str) -> dict[str, Column]:
    """What tells documents apart: id and text, as one row each however often repeated."""
    return {"doc_id": col(id), "body": F.xxhash64(F.coalesce(col(text), F.lit("")))}


def _lines(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Lines with a word: where they stand, 96 bits of hash, words, and words before."""
    split = docs.select(*[e.alias(k) for k, e in _named(docs, id, text).items()], F.posexplode(_split(col(text))).alias("pos", "line"))
    words = split.select(
        *NAME, "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), F.regexp_count("line", F.lit(WORD)).alias("words")
    )
    own = Window.partitionBy(*NAME)
    before = F.coalesce(F.sum("words").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # rows alike in id and text yield each line several times; the first of each is enough
    once = F.row_number().over(own.orderBy("pos").partitionBy(*NAME, "pos")) == 1
    return (
        words.where("words > 0").withColumn("once", once).where("once").drop("once")
        .select("*", before.alias("before"), F.sum("words").over(own).alias("total"))
    )


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """All whole windows: first and last line, fingerprint, and a hash of all their lines in order."""
    frame = Window.partitionBy(*NAME).orderBy("before").rangeBetween(0, min_words - 1)
    content = F.collect_list(F.struct("h1", "h2")).over(frame)
    return (
        lines.select(
            *NAME, F.col("pos").alias("first"), F.max("pos").over(frame).alias("last"),
            F.min(F.struct("h1", "h2", (-F.col("pos")).alias("back"))).over(frame).alias("lowest"), content.alias("content"),
            "before", "total",
        )
        .where(F.col("before") + min_words <= F.col("total"))
        .select(
            *NAME, "first", "last", F.col("lowest.h1").alias("mark"), F.col("lowest.h2").alias("mark2"),
            (-F.col("lowest.back")).alias("at"), F.xxhash64("content").alias("c1"), F.hash("content").alias("c2"),
        )
    )


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal later runs: doc_id, body, first, last (lines counted from 0)."""
    windows = staged(_windows(_lines(docs, id, text), min_words))
    place = F.struct("doc_id", "body", "at")
    marks = staged(
        windows.groupBy("mark", "mark2").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count(F.lit(1)).alias("n"))
        .where("low != high").select("mark", "mark2")
    )
    met = staged(windows.join(marks, ["mark", "mark2"], "left_semi"))
    key = ["mark", "mark2", "c1", "c2"]
    firsts = staged(
        met.groupBy(*key).agg(F.min(F.struct("doc_id", "body", "first", "last")).alias("origin"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").drop("n")
    )
    same_text = F.col("doc_id").eqNullSafe(F.col("origin.doc_id")) & (F.col("body") == F.col("origin.body"))
    later = (
        met.join(firsts, key)
        .where(~(same_text & (F.col("first") == F.col("origin.first"))))
        # a run that overlaps its own first occurrence leaves that one whole
        .withColumn("first", F.when(same_text, F.greatest("first", F.col("origin.last") + 1)).otherwise(F.col("first")))
        .select(*NAME, "first", "last")
        .where("first <= last")
    )
    inside = Window.partitionBy(*NAME).orderBy("first", "last")
    reached = F.max("last").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("first") > reached + 1, F.lit(True))
    return (
        later.withColumn("new", begins.cast("int")).withColumn("run", F.sum("new").over(inside))
        .groupBy(*NAME, "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")
    )


def delete_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_removed, runs, text without the lines of ``runs``.

    Of runs of whole lines with ``min_words`` words or more that occur more than once, all but the first in
    order of id (null first) and line are deleted. Lines without a word neither match nor
    separate; they go only where a run passes over them. Rows alike in id and text are one
    document: they keep or lose the same lines. A null text has one empty line and stays null. Other
    columns of ``docs``, whatever their names, are not read. Empty in, empty out.
    """
    runs = staged(repeated_runs(docs, min_words, id, text))
    found = runs.groupBy(*NAME).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("cuts")).withColumnsRenamed(
        {k: f"of_{k}" for k in NAME}
    )
    full = docs.select(*[e.alias(k) for k, e in _named(docs, id, text).items()], col(text).alias("text"))
    # texts are shuffled to the few runs at every size; only the runs are hashed
    joined = full.join(found.hint("shuffle_hash"), full["doc_id"].eqNullSafe(found["of_doc_id"]) & (full["body"] == found["of_body"]), "left")
    lines = _split(F.col("text"))
    stays = lambda line, i: ~F.exists("cuts", lambda r: (r["first"] <= i) & (i <= r["last"]))
    sizes = F.aggregate("cuts", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    return joined.select(
        F.col("doc_id").alias(id), F.size(lines).cast("long").alias("n_lines"), F.coalesce(sizes, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.concat_ws(",", F.transform("cuts", lambda r: F.concat_ws("-", r["first"], r["last"]))), F.lit("")).alias("runs"),
        F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, stays), "\n")).alias("text"),
    )
