"""Files that hold one JSON array each, read by as many tasks as they have splits.

Spark's text reader cuts a file at every ``}`` and deals stretches of it (splits) to tasks. Where a
split begins, nobody knows whether a string is open or how deep the brackets are. So a first scan
sums up each split: whether its quotes change the string state, and how the depth changes if it
begins outside a string or inside one. Prefix sums over the splits of a file, a few numbers each,
tell the state every split begins in. The second scan then knows where records end: at a closing
bracket outside strings that leads back to depth one. Records that lie across splits are put
together from their fragments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.sources.storage import work_folder
from emberline.sources.workers import ship_package

#: Splits whose states are sent to all tasks; more of them meet their pieces in a shuffle.
MAX_SENT = 100_000
#: White space of JSON, and the mark that may begin a file.
BLANK = " \t\r\n\ufeff"

_SPLIT = ("file", "start")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the split) and value: the text up to and with each ``}``; the last piece of a file gets one too."""
    text = spark.read.option("lineSep", "}").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return text.select(*place, F.concat("value", F.lit("}")).alias("value"))


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All text of ``values`` in one array, and where each value ends in it."""
    _, offsets, data = values.buffers()
    kind = np.int64 if pa.types.is_large_string(values.type) else np.int32
    ends = np.frombuffer(offsets, kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends[1:] - ends[0]


def structure(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: how many quotes up to it open or close strings, and its step in depth if it is outside of them."""
    quote = raw == ord('"')
    slashes = np.flatnonzero(raw == ord("\\"))
    if len(slashes):
        first = np.flatnonzero(np.r_[True, np.diff(slashes) != 1])
        run = np.diff(np.r_[first, len(slashes)])
        after = (slashes[first] + run)[run % 2 == 1]
        quote[after[after < len(raw)]] = False
    lower = raw | 32
    return np.cumsum(quote), (lower == ord("{")).astype(np.int64) - (lower == ord("}"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """The pieces of each split in a batch."""
    files, starts = batch.column(0), batch.column(1).to_numpy()
    codes = files.dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1
    for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(starts)].tolist(), strict=True):
        if b > a:
            yield files[a].as_py(), int(starts[a]), batch.column(2).slice(a, b - a)


_SUMMARY = "file string, start long, quotes int, outside long, inside long, opens boolean, closes boolean"


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, total, found = None, None, []
    for batch in batches:
        for file, start, values in _runs(batch):
            if (file, start) != now:
                if now is not None:
                    found.append((*now, *total))
                opens = values[0].as_py().lstrip(BLANK).startswith("[")
                now, total = (file, start), [0, 0, 0, opens, False]
            quotes, steps = structure(_bytes(values)[0])
            within = (quotes + total[0]) % 2 == 1
            total[1] += int(steps[~within].sum())
            total[2] += int(steps[within].sum())
            total[0] = int(total[0] + quotes[-1]) % 2
            total[4] = values[len(values) - 1].as_py()[:-1].rstrip(BLANK).endswith("]")
    if now is not None:
        found.append((*now, *total))
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
    columns = list(zip(*found, strict=True)) or [()] * len(kinds)
    names = [f.split()[0] for f in _SUMMARY.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def split_states(cut: DataFrame) -> DataFrame:
    """file, start, string (is one open) and depth at the beginning of each split; is it the ``last`` of its file, is that a ``whole`` array.

    Windows run over the splits of a file, one row each.
    """
    order = Window.partitionBy("file").orderBy("start")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    sums = cut.mapInArrow(_summarise, _SUMMARY)
    sums = sums.withColumn("string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    sums = sums.withColumn("step", F.when(F.col("string") == 1, F.col("inside")).otherwise(F.col("outside")))
    depth = F.coalesce(F.sum("step").over(before), F.lit(0))
    # the bracket added to the last piece closes once more than the array
    ends = (F.sum("step").over(every) == -1) & (F.sum("quotes").over(every) % 2 == 0)
    whole = ends & F.min_by("opens", "start").over(every) & F.max_by("closes", "start").over(every)
    last = F.lead("start").over(order).isNull()
    return sums.select(*_SPLIT, F.col("string").cast("int").alias("string"), depth.alias("depth"), last.alias("last"), whole.alias("whole"))


_FOUND = "file string, start long, kind int, text string"
#: What a stretch of text is: a record; the end of one begun before; the begin of one that goes on, or what follows the last.
RECORD, TAIL, HEAD = 0, 1, 2


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, string, depth, end, held, tail = None, 0, 0, False, [], False

    def some(kind, texts):
        n = len(texts)
        columns = [pa.array([now[0]] * n), pa.array([now[1]] * n, pa.int64()), pa.array([kind] * n, pa.int32()), texts]
        return pa.RecordBatch.from_arrays(columns, names=["file", "start", "kind", "text"])

    def rest():
        """What is held at the end of a split; after the last record of a file, without the array's bracket and the one added."""
        text = "".join(held)
        if end and not tail:
            return some(RECORD, pa.array([text[:-1].rstrip(BLANK)[:-1]], pa.string()))
        return some(HEAD, pa.array([text], pa.string()))

    for batch in batches:
        states = batch.select(["string", "depth", "last"])
        row = 0
        for file, start, values in _runs(batch):
            if (file, start) != now:
                if held:
                    yield rest()
                now, held = (file, start), []
                string, depth, end = (c[row].as_py() for c in states.columns)
                tail = string == 1 or depth > 1
            row += len(values)
            raw, ends = _bytes(values)
            quotes, steps = structure(raw)
            within = (quotes + string) % 2 == 1
            depths = depth + np.cumsum(np.where(within, 0, steps))
            last = np.flatnonzero((depths[ends - 1] == 1) & ~within[ends - 1])
            string, depth = int(quotes[-1] + string) % 2, int(depths[-1])
            if not len(last):
                held += values.to_pylist()
                continue
            begins = np.r_[0, last[:-1] + 1]
            first, whole = 0, raw.tobytes()
            if held or tail:  # the first end here closes what was held
                text = "".join(held) + whole[: ends[last[0]]].decode()
                yield some(TAIL if tail else RECORD, pa.array([text], pa.string()))
                first, held, tail = 1, [], False
            if len(last) > first:
                offsets = np.r_[0, ends][np.r_[begins[first:], last[-1] + 1]].astype(np.int32)
                yield some(RECORD, pa.StringArray.from_buffers(len(last) - first, pa.py_buffer(offsets), pa.py_buffer(whole)))
            if last[-1] + 1 < len(values):
                held = values.slice(last[-1] + 1).to_pylist()
    if held:
        yield rest()


def _joined(fragments: DataFrame) -> DataFrame:
    """The texts that lie across splits of a file: one for each record, and what follows the last one."""
    order = Window.partitionBy("file").orderBy("start", "kind")
    tails = F.coalesce(F.sum((F.col("kind") == TAIL).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = fragments.withColumn("nth", tails).groupBy("file", "nth")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", "text"))), lambda x: x["text"]), "")
    # the piece after the last record ends with the array's own bracket and the one added to it
    return parts.agg(text.alias("text"), (F.max_by("kind", F.struct("start", "kind")) != TAIL).alias("end")).withColumn(
        "text", F.when(F.col("end"), F.regexp_replace("text", r"\][\s\x{feff}]*\}$", "")).otherwise(F.col("text"))
    )


def _records(found: DataFrame) -> DataFrame:
    """record and broken from the texts between the ends of records: mostly a comma and an object."""
    blank = F.lit(BLANK)
    text = F.ltrim("text", blank)
    after = F.ltrim(F.substr(text, F.lit(2)), blank)
    parted = F.substring(text, 1, 1).isin("[", ",")
    plain = found.select(F.when(parted & after.startswith("{"), after).alias("record"), text.alias("text"), parted.alias("parted"))
    # other elements before the object, or no comma
    listed = F.from_json(F.when(F.col("parted"), F.concat(F.lit("["), F.substr("text", F.lit(2)), F.lit("]"))), "array<string>")
    odd = F.when(F.col("record").isNotNull(), F.array("record")).when(F.col("text") != "", listed).otherwise(F.array().cast("array<string>"))
    every = plain.select(F.explode_outer(odd).alias("record"), odd.isNull().alias("broken"))
    return every.where("broken or record is not null")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """record (the text of an element of an array) and broken, for all files of ``path``.

    A file that is not one closed array is a single broken record, and so is text between records that
    no element can be. Null elements are left out; elements that are no objects come as their text. An empty file has no records.
    Where splits begin inside records (nested objects), the text is scanned once more for those that lie across.
    Splits must be the same in both scans: should the session's settings change in between, it is an error.
    """
    ship_package(spark)
    cut, folder = pieces(spark, path), f"{work_folder(spark)}/splits"
    split_states(cut).write.parquet(folder)
    states = spark.read.parquet(folder)
    splits, within = states.agg(F.count("*"), F.count_if(F.col("whole") & ((F.col("string") == 1) | (F.col("depth") > 1)))).first()
    known = states.withColumnsRenamed({"file": "s_file", "start": "s_start"})
    same = (F.col("file") == F.col("s_file")) & (F.col("start") == F.col("s_start"))
    if splits <= MAX_SENT:
        met = cut.join(F.broadcast(known), same, "left")
    else:
        placed = cut.withColumn("nth", F.monotonically_increasing_id())
        met = placed.join(known, same, "left").repartition(*_SPLIT).sortWithinPartitions(*_SPLIT, "nth")
    checked = F.coalesce("whole", F.raise_error(F.lit("the splits of a JSON file changed between two scans")).cast("boolean"))
    found = met.where(checked).select(*_SPLIT, "value", "string", "depth", "last").mapInArrow(_cut_records, _FOUND)
    bad = states.where(~F.col("whole")).select("file").distinct().select(F.lit(None).cast("string").alias("record"), F.lit(True).alias("broken"))
    if within == 0:
        return _records(found.select("text")).unionByName(bad)
    across = _joined(found.where(F.col("kind") != RECORD)).select("text")
    return _records(found.where(F.col("kind") == RECORD).select("text")).unionByName(_records(across)).unionByName(bad)
