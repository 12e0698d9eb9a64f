from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from emberline.llm import queries, warc
from tests.llm.conftest import SF_DIR

BIG = "x" * 500 + "\r\n\r\nWARC/1.1\r\n" + "é" * 700
PAGES = [
    (1, "http://a.b/c", BIG), (2, "http://a.b/c", BIG), (2, "http://a.b/c", BIG), (3, "http://q/\r\n", None), (4, None, ""), (4, None, ""),
    (5, "http://[bad", BIG + "y"), (6, "x", BIG + "y"), (6, "y", BIG + "y"), (None, "http://A.B/c", BIG), (7, "http://a.b/d", "short"), (8, "", "short"),
]


def check(rows, pages):
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in rows) == Counter(
        (i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in pages
    )
    groups = {}
    for r in rows:
        if r["payload_bytes"] >= 1000:
            groups.setdefault(r["payload_digest"], []).append(r)
        else:
            assert (r["record_type"], r["refers_to"]) == ("response", None)
    for same in groups.values():
        top = max(r["page_id"] if r["page_id"] is not None else -1 for r in same)
        assert [r["page_id"] for r in same if r["record_type"] == "response"] == [top]
        assert all(r["refers_to"] == (top if r["record_type"] == "revisit" else None) for r in same)


def test_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url", "html").collect()]
    rows = queries.op6_warc(spark, SF_DIR).collect()
    check(rows, pages)


def test_edges(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string").repartition(4)
    index = warc.archive_and_index(pages, F.lit("2024-01-01T00:00:00Z"), archive_bytes=4000)
    rows = index.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")}).collect()
    check(rows, PAGES)
    order = [(r["urlkey"], r["date"]) for r in rows]
    assert order == sorted(order)
    assert warc.archive_and_index(pages.limit(0), F.lit("2024-01-01T00:00:00Z")).count() == 0


def test_index_points_into_the_archives(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for r in warc.archive_and_index(pages, F.lit("2024-01-01T00:00:00Z"), folder=str(tmp_path / "archives")).collect():
        with open(r["archive"].removeprefix("file:"), "rb") as file:
            data = file.read()[r["offset"] : r["offset"] + r["length"]]
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n") and r["payload_digest"].encode() in data


def test_archives_are_bounded_where_long_pages_stand_together(spark, tmp_path):
    """One page in a hundred is 200 times as long as the mean, all of them in one partition."""
    pages = [(i, f"http://s/{i}", f"{i} " + "x" * (200 * 500 if i < 30 else 500)) for i in range(3000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).sortWithinPartitions("page_id")
    warc.write_archives(df, str(tmp_path / "a"), F.lit("2024-01-01T00:00:00Z"), archive_bytes=250_000)
    sizes = [f.stat().st_size for f in (tmp_path / "a").rglob("part-*")]
    assert len(sizes) > 10 and max(sizes) <= 250_000 + 100
    assert warc.read_runs(spark, str(tmp_path / "a")).count() == 3000


def test_merge_in_many_ranges(spark, tmp_path, rng):
    pages = [(i, f"http://s/{rng.randrange(40)}", f"{i}") for i in range(900)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(6)
    warc.write_archives(df, str(tmp_path / "a"), F.lit("2024-01-01T00:00:00Z"), archive_bytes=20_000)
    merged = warc.merge_runs(warc.read_runs(spark, str(tmp_path / "a")), range_lines=100)
    assert merged.rdd.getNumPartitions() == 9
    rows = [(r["urlkey"], r["date"], r["page_id"]) for r in merged.collect()]
    assert len(rows) == 900 and rows == sorted(rows)


def test_loser_tree(rng):
    for k in range(12):
        runs = [sorted((rng.randint(0, 20), j) for j in range(rng.randint(0, 15))) for _ in range(k)]
        merged = list(warc.LoserTree([iter(r) for r in runs]))
        assert [head for _, head in merged] == sorted(x for r in runs for x in r)
        assert all(head in runs[run] for run, head in merged)
    ties = [[(1, "a")], [(1, "a")], [(1, "a")]]
    assert [run for run, _ in warc.LoserTree([iter(r) for r in ties])] == [0, 1, 2]


def test_url_keys():
    assert warc.url_key("https://www.Example.com:80/a/b?q=1#top") == "com,example,www)/a/b?q=1"
    assert warc.url_key(None) == ")/" and warc.url_key("http://[bad") == "http://[bad"
