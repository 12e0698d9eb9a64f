from __future__ import annotations

import base64
import os
import random

import public_tokenizers
import pytest

#: (doc_id, text): nulls, empty texts, repeated rows, ties, very long texts, odd characters.
LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
PROSE = "It was a quiet morning in the town and the baker had opened early.\nNobody knew why the bells were ringing so late that day."
ROWS = [
    (1, PROSE),
    (2, PROSE),
    (2, PROSE),
    (7, PROSE),
    (None, PROSE),
    (None, None),
    (3, None),
    (4, ""),
    (5, ""),
    (5, ""),
    (6, " \t\n"),
    (8, LONG),
    (9, LONG + " end"),
    (10, "don't we'll I've 'sup  two   spaces\n\n\tx é中\U0001f600 12² !?' '"),
    (11, "<|endoftext|>a<|endoftext|>"),
    (12, "a" * 5000),
    (-3, "negative id"),
]
#: Columns whose names the operators use themselves.
CLASHING = ("kept", "shard", "slot", "digest", "row", "fp", "part", "nth", "winner", "label", "host", "path", "evidence", "ids", "ends", "lang.x")


@pytest.fixture(scope="session")
def messy(spark):
    return documents(spark, ROWS)


def documents(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, None if i % 3 else "en", "src0", None, *CLASHING) for i, r in enumerate(rows)], schema).repartition(3)


@pytest.fixture(scope="session")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@pytest.fixture(scope="session")
def given(spark):
    """Id and text of the smallest given table."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def rng():
    return random.Random(20240101)
