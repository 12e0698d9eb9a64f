"""WARC archives of captures, and one globally ordered index over them.

Records are written by Spark's text writer: a record is a string, the separator is the blank lines
that end a WARC record. Of equal payloads one capture is the response and others revisit it.
Each archive read back gives a run of index lines sorted by URL key and time; runs are dealt by
key range, so many that a range is of a bounded size, and each range merges its slices of all runs
with a loser tree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.common import col, map_batches, staged
from emberline.llm.exact_dedup import with_winner
from emberline.sources.storage import work_folder

#: Payloads from this size on may be replaced by a revisit.
LEAST_REVISITED = 1000
#: Bytes after which the next record goes to another archive; a reader holds one archive in memory.
ARCHIVE_BYTES = 16 << 20
#: Index lines that one range of the merge holds, about.
RANGE_LINES = 200_000

# Names and forms that the WARC format gives.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = T.StructType(
    [
        T.StructField("urlkey", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("page_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)
KEY = ("urlkey", "date", "page_id")

# ---------------------------------------------------------------- writing


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _record(page_id: Column, url: Column, date: Column, payload: Column, digest: Column, refers_to: Column, revisit: Column) -> Column:
    """A WARC record without its final blank lines."""
    name = lambda x: F.concat(F.lit("<urn:capture:"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.octet_length(payload).cast("string")),
        F.lit("\r\n"),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(payload))
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", name(page_id)),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        _line("WARC-Refers-To", F.when(revisit, name(refers_to))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def _numbered(archive_bytes: int) -> Callable:
    """Adds to each record of a task the number of its archive, by a running sum of bytes."""

    def each(batches):
        number, filled = 0, 0
        for batch in batches:
            numbers = []
            for size in pc.binary_length(batch.column(0)).to_pylist():
                if filled and filled + size > archive_bytes:
                    number, filled = number + 1, 0
                filled += size + len(END)
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int32())], names=["value", "archive"])

    return each


def write_archives(
    pages: DataFrame, folder: str, date: Column, id: str = "page_id", url: str = "url", html: str = "html",
    least: int = LEAST_REVISITED, archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write one record per row of ``pages`` into archives under ``folder``.

    A null html is an empty payload. Of rows with equal payloads of ``least`` bytes or more that with
    the largest id (of those, the largest url) is the response; the others revisit it. Of rows
    alike in id, url and payload one is the response. A null id is the smallest. Other columns of
    ``pages`` are not read. An empty table writes no record. An archive holds ``archive_bytes`` at
    most, or a single record that is larger.
    """
    payload = F.coalesce(col(html), F.lit(""))
    full = pages.select(
        col(id).alias("page_id"), col(url).alias("url"), date.alias("date"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest")
    )
    rows = staged(full.select("page_id", "url", "digest", F.octet_length("payload").alias("bytes")))
    repeated = (
        with_winner(rows.where(F.col("bytes") >= least), "digest", F.struct("page_id", "url"))
        .where("group_size > 1")
        .groupBy("page_id", "url", "digest")
        .agg(F.first("winner").alias("winner"), F.count(F.lit(1)).alias("n"))
        .select(
            F.col("page_id").alias("marked_id"), F.col("url").alias("marked_url"), F.col("digest").alias("marked_digest"),
            F.col("winner.page_id").alias("refers_to"), "n", (F.col("winner") == F.struct("page_id", "url")).alias("wins"), F.lit(True).alias("marked"),
        )
    )
    marks = staged(repeated)
    met = full.join(
        marks,
        full["page_id"].eqNullSafe(marks["marked_id"]) & full["url"].eqNullSafe(marks["marked_url"]) & (full["digest"] == marks["marked_digest"]),
        "left",
    )
    alike = F.col("wins") & (F.col("n") > 1)
    columns = ["page_id", "url", "date", "payload", "digest", "refers_to"]
    single = met.where(~F.coalesce(alike, F.lit(False))).select(*columns, (F.col("marked").isNotNull() & ~F.coalesce("wins", F.lit(False))).alias("revisit"))
    if not marks.where("wins and n > 1").isEmpty():
        # rows alike in all that a record holds are reduced to one, and counted out again
        several = (
            met.where(alike).groupBy("page_id", "url", "digest").agg(*[F.first(c).alias(c) for c in ("date", "payload", "refers_to", "n")])
            .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
        )
        single = single.unionByName(several.select(*columns, (F.col("copy") > 1).alias("revisit")))
    record = _record(*[F.col(c) for c in (*columns, "revisit")])
    numbered = map_batches(single.select(record.alias("value")), _numbered(archive_bytes), "value string, archive int")
    numbered.write.option("lineSep", END).partitionBy("archive").mode("overwrite").text(folder)


# ---------------------------------------------------------------- reading


def url_key(url: str | None) -> str:
    """The URL with its host reversed, so that a site's captures stand together; no scheme or fragment."""
    try:
        parts = urlsplit(url or "")
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return (url or "").lower()
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


_HEADER = re.compile(rb"([^\r\n:]+): ?([^\r\n]*)\r\n")


def read_records(data: bytes) -> Iterator[tuple[int, int, dict[bytes, bytes], bytes]]:
    """Offset, length, headers and block of each record of an archive, by its Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(END.encode(), at) + 2
        if not data.startswith(VERSION.encode(), at):
            raise ValueError(f"no record at {at}")
        headers = {k.lower(): v for k, v in _HEADER.findall(data[data.index(b"\r\n", at) + 2 : end])}
        begin = end + 2
        stop = begin + int(headers[b"content-length"])
        yield at, stop + len(END) - at, headers, data[begin:stop]
        at = stop + len(END)


def _named(value: bytes | None) -> str | None:
    found = re.fullmatch(rb"<urn:capture:(.*)>", value or b"")
    return found[1].decode() if found and found[1] else None


def _index_line(archive: str, offset: int, length: int, headers: dict[bytes, bytes], block: bytes) -> dict:
    http, _, payload = block.partition(END.encode())
    kind = headers[b"warc-type"].decode()
    digest = headers[b"warc-payload-digest"].decode().removeprefix("sha1:")
    size = int(dict((k.lower(), v) for k, v in _HEADER.findall(http + b"\r\n"))[b"content-length"])
    if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
        raise ValueError(f"{archive} at {offset}: the payload is not what the headers say")
    url = headers.get(b"warc-target-uri")
    url = None if url is None else url.decode()
    return {
        "urlkey": url_key(url), "date": headers.get(b"warc-date", b"").decode(), "page_id": _named(headers[b"warc-record-id"]), "url": url,
        "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": _named(headers.get(b"warc-refers-to")),
        "archive": archive, "offset": offset, "length": length,
    }


def _order(line: dict) -> tuple[str, str, str]:
    return line["urlkey"], line["date"], line["page_id"] or ""


def _runs(schema: pa.Schema) -> Callable:
    def each(batches):
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lines = [_index_line(archive, *record) for record in read_records(data.as_buffer().to_pybytes())]
                yield from pa.Table.from_pylist(sorted(lines, key=_order), schema=schema).to_batches()

    return each


def read_runs(spark, folder: str) -> DataFrame:
    """The index lines of all archives in ``folder``: each archive a run sorted by key, stored."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    schema = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in INDEX])
    return staged(map_batches(files, _runs(schema), INDEX))


# ---------------------------------------------------------------- merging


class LoserTree:
    """Merges sorted sequences. Each inner node holds the loser of its match; the winner moves up."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.size = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.losers = [-1] * self.size
        for i in range(self.size):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, winner: int) -> None:
        node = (winner + self.size) // 2
        while node > 0:
            if self.losers[node] < 0:  # while it is built, the first to come waits here
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        while (head := self.heads[self.losers[0]]) is not None:
            run = self.losers[0]
            yield run, head
            self.heads[run] = next(self.runs[run], None)
            self._play(run)


def _merging() -> Callable:
    def each(batches):
        slices: dict[str, list[tuple]] = {}
        lines, n = [], 0
        for batch in batches:  # one key range of the index: a slice of each run, in the order of the run
            lines.append(batch)
            columns = [batch.column(k).to_pylist() for k in (*KEY, "archive")]
            for urlkey, date, page, archive in zip(*columns, strict=True):
                slices.setdefault(archive, []).append((urlkey or "", date or "", page or "", n))
                n += 1
        for archive, run in slices.items():
            if any(a > b for a, b in zip(run, run[1:], strict=False)):  # a slice that came in pieces out of order
                slices[archive] = sorted(run)
        if n:
            tree = LoserTree([iter(slices[a]) for a in sorted(slices)])
            order = pa.array([head[-1] for _, head in tree], pa.int64())
            yield from pa.Table.from_batches(lines).take(order).combine_chunks().to_batches(max_chunksize=10_000)

    return each


def merge_runs(runs: DataFrame, range_lines: int = RANGE_LINES) -> DataFrame:
    """The lines of all ``runs`` in one order by URL key, time and page, across partitions too.

    Ranges are cut by the whole key, so that a URL with very many captures spans several, and there are as many
    as ``range_lines`` asks for; lines alike in their whole key stay together. A task holds one range.
    """
    ranges = max(1, -(-runs.count() // range_lines))
    dealt = runs.repartitionByRange(ranges, *[F.col(k).asc_nulls_first() for k in KEY])
    return map_batches(dealt, _merging(), runs.schema)


def archive_and_index(pages: DataFrame, date: Column, folder: str | None = None, **names) -> DataFrame:
    """Write ``pages`` to archives, read them back, and return the merged index (ids as strings)."""
    folder = folder or f"{work_folder(pages.sparkSession)}/archives"
    write_archives(pages, folder, date, **names)
    return merge_runs(read_runs(pages.sparkSession, folder))
