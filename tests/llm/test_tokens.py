"""Byte-level BPE and packing."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given as examples
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberline.llm import byte_bpe, packing, queries
from emberline.llm.byte_bpe import ByteBpe
from tests.llm.conftest import LONG, ROWS, SF_DIR

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def known(ranks):
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    with open(RANKS, "rb") as file:
        return ByteBpe(file.read())


def each(bpe, texts):
    ids, counts = bpe.encode(texts)
    ends = np.cumsum(counts)
    return [ids[a:b].tolist() for a, b in zip(ends - counts, ends, strict=True)]


PARTS = [*"'stmdrevlaZ1!_$ \n\t\r", "'s", "'re", "'ll", "  ", "é", "²", "中", "\U0001f600", "́", "\x1c", "\x85", "　"]


def test_like_the_library(own, known, rng):
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(5000)] + ["", "'" * 40 + "s", " " * 99, "ab" * 2000, LONG]
    assert each(own, texts) == [known.encode_ordinary(t) for t in texts]


def test_every_code_point(own, known):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{c}a 1{c}1 {c} {c}\n{c}x" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    assert each(own, texts) == [known.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@examples(st.text())
def test_round_trip(own, known, text):
    (ids,) = each(own, [text])
    assert ids == known.encode_ordinary(text)
    ends = np.cumsum(own.lengths[ids]) if ids else np.zeros(0, np.int64)
    assert own.decode(np.array(ids, np.int64), ends) == text.encode()


def test_windows_do_not_show(own, known, rng, monkeypatch):
    monkeypatch.setattr(byte_bpe, "WINDOW", 50)
    texts = ["".join(rng.choices(PARTS, k=2000)) for _ in range(20)] + ["a" * 700, " " * 300 + "b"]
    assert each(own, texts) == [known.encode_ordinary(t) for t in texts]


def test_a_full_cache_begins_anew(own, known, monkeypatch):
    monkeypatch.setattr(ByteBpe, "CACHED", 100)
    texts = [LONG[i : i + 3000] for i in range(0, 60_000, 3000)]
    assert [each(own, [t])[0] for t in texts] == [known.encode_ordinary(t) for t in texts]


def test_json_vocabulary_and_special_tokens(rng):
    with open(JSON, "rb") as file:
        bpe = ByteBpe(file.read())
    library = Tokenizer.from_file(JSON)
    texts = [t or "" for _, t in ROWS if t is not LONG] + ["".join(rng.choices(PARTS, k=60)) for _ in range(500)]
    assert each(bpe, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def digest(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_encoding_query(spark, given, known):
    rows = {r["doc_id"]: r for r in queries.op2_byte_bpe(spark, SF_DIR).collect()}
    assert len(rows) == len(given)
    for i, t in given:
        ids = known.encode_ordinary(t)
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"]) == (len(ids), digest(ids))
        assert rows[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_encoding_edges(messy, known):
    encoded = byte_bpe.encode_documents(messy, RANKS)
    rows = byte_bpe.decode_documents(encoded, RANKS).collect()
    expected = Counter((i, tuple(known.encode_ordinary(t or "")), (t or "").encode()) for i, t in ROWS)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), bytes(r["decoded"])) for r in rows) == expected
    assert byte_bpe.decode_documents(byte_bpe.encode_documents(messy.limit(0), RANKS), RANKS).count() == 0


def check_packing(rows, ids, capacity):
    """Every piece right and each once, every sequence gapless and within capacity."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, texts in ids.items():
        expected = []
        for own in texts:
            for n, (a, size) in enumerate(packing.cut(len(own), capacity)):
                expected.append((n, a, size, zlib.crc32(np.array(own[a : a + size], "<u4").tobytes())))
        assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[i]) == Counter(expected)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(sequences)


def test_packing_query(spark, given, known):
    rows = queries.op10_packing(spark, SF_DIR).collect()
    ids = {i: [known.encode_ordinary(t) + [2]] for i, t in given}
    used = check_packing(rows, ids, 1024)
    assert used <= -(-sum(r["length"] for r in rows) // 1024) + 2


def test_packing_edges(messy):
    library, ids = Tokenizer.from_file(JSON), {}
    for i, t in ROWS:
        ids.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [2])
    check_packing(packing.pack_documents(messy, JSON, capacity=64).collect(), ids, 64)
    assert packing.pack_documents(messy.limit(0), JSON).count() == 0


def test_cutting():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


@settings(max_examples=200, deadline=None)
@examples(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=25))
def test_plans_hold_every_piece(counts):
    patterns = packing.plan(counts, 40)
    held = Counter()
    for lengths, times in patterns:
        assert sum(lengths) <= 40 and times > 0
        for x in lengths:
            held[x] += times
    assert held == Counter({k: v for k, v in counts.items() if v})
    # never more than twice what the tokens need, as any plan with one open half-empty sequence
    total = sum(k * v for k, v in counts.items())
    assert sum(n for _, n in patterns) <= 2 * -(-total // 40)


def test_exact_combinations_fill_sequences():
    assert sum(n for _, n in packing.plan({60: 5, 40: 5}, 100)) == 5
    assert sum(n for _, n in packing.plan({50: 4, 30: 4, 20: 4}, 100)) == 4
    assert sum(n for _, n in packing.plan({40: 3, 30: 3, 20: 3, 10: 3}, 100)) == 3
