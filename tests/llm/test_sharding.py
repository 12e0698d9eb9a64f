from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

from emberline.llm import queries
from emberline.llm.sharding import assign_shards, jump_shard
from tests.llm.conftest import ROWS, SF_DIR


def jump(key: int, shards: int) -> int:
    key &= 2**64 - 1
    at, to = -1, 0
    while to < shards:
        at = to
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        to = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def gapless(rows):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_the_walk_is_the_published_one(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(100, 400)]
    for shards in (1, 2, 16, 300):
        rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_shard(F.col("k"), shards).alias("at")).collect()
        assert [(r["at"]["shard"], r["at"]["grown"]) for r in rows] == [(jump(r["k"], shards), jump(r["k"], shards + 1)) for r in rows]


def test_query(spark, given):
    rows, texts = queries.op1_sharding(spark, SF_DIR).collect(), dict(given)
    assert len(rows) == len(given) and gapless(rows)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 16), jump(r["doc_id"], 17))
        assert r["grown_shard"] in (r["shard"], 16)


def test_edges(spark, messy):
    rows = assign_shards(messy, 4).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ROWS) and gapless(rows)
    assert {r["size"] for r in rows if r["doc_id"] == 3} == {1}
    assert all(r["shard"] == jump(r["doc_id"] or 0, 4) for r in rows)
    assert assign_shards(messy.limit(0), 4).count() == 0
    text_key = assign_shards(messy, 4, key="text").collect()
    assert len(text_key) == len(ROWS) and gapless(text_key)
