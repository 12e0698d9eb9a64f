"""Conversation repair against a plain shortest-string search and a plain reading of the damage rules."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from emberline.llm import conversations, queries
from tests.llm.conftest import SF_DIR

WORD = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(kinds: tuple[tuple[str, bool, bool], ...]) -> tuple[int, str]:
    """Least (cost, edits) for turns of (initial, must go, truncated), by trying every edit at every place."""
    goes = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i: int, last: str, added: int) -> tuple[int, str]:
        found = []
        if i == len(kinds):
            found = [(0, "")] if last in ("", "a") else []
        else:
            initial, must_go, cut = kinds[i]
            steps = [("D", 2, last)]
            if not must_go:
                steps += [("K", 5 * cut, goes[last, initial])] if (last, initial) in goes else []
                steps += [("R", 1 + 5 * cut, goes[last, role]) for role in "ua" if (last, role) in goes]
            for edit, cost, to in steps:
                c, rest = best(i + 1, to, 0)
                found.append((cost + c, edit + rest))
        if added < 3:
            for role in "ua":
                if (last, role) in goes:
                    c, rest = best(i, role, added + 1)
                    found.append((5 + c, "I" + rest))
        return min(found, default=(10**9, ""))

    return best(0, "", 0)


def slow_report(rows):
    """The answer for ``rows`` of (conv_id, turn, role, text), one conversation after the other."""
    told = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text, harm = told(role), told(text), zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        if harm == 1:
            text = ""
        elif harm == 2:
            text = re.sub("[.!?]", "", text)
        elif harm == 4:
            role = "user"
        kept.extend([(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1))
    answer = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in turns:
            marks = WORD.findall(text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None
            faults.append(fault)
            seen.add((role, text))
        cost, audit = cheapest(tuple((t[1][:1], f in ("blank", "duplicate"), f == "truncated") for t, f in zip(turns, faults, strict=True)))
        out, state, i = [], "", 0
        for edit in audit:
            role, text = ("user" if state != "u" else "assistant"), ""
            if edit != "I":
                _, old, text = turns[i]
                i += 1
                role = old if edit == "K" else role
            if edit != "D":
                out.append(f"{role}:{text}")
                state = role[0]
        numbers = [t[0] for t in turns if t[0] is not None]
        initials = [t[1][:1] for t in turns]
        answer[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
        )
    return answer


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_tables_against_every_edit():
    known, rng = conversations.tables(), random.Random(3)
    end = known.number[conversations._normal(conversations.END)[0]]
    for n in range(1, 14):
        for _ in range(60):
            kinds = [rng.randrange(conversations.CLASSES) for _ in range(n)]
            edits, state = known.trace(np.array(kinds, np.uint8), end)[0]
            edits += {1: "II", 2: "I"}.get(state, "")
            _, total = known.read(np.array(kinds, np.uint8), end)
            named = tuple(("suat"[k // 2] if k < 8 else "", k == 8, k % 2 == 1) for k in kinds)
            cost, audit = cheapest(named)
            assert edits == audit
            assert known.vectors[known.read(np.array(kinds, np.uint8), end)[0][0]][0] + total == cost


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_conversations(spark, SF_DIR)) == slow_report(rows)


def messy(rng):
    rows = []
    for conv in [None, -1, 3, 4, 5, 6, 7, 8]:
        for turn in [None, None, *range(rng.randrange(30))]:
            role = rng.choice(["system", "user", "assistant", "tool", "", None, "üser", "a", "s"])
            rows.append((conv, turn, role, rng.choice(["Yes.", "No", " \t\n", "", None, "Why? \x0b", "done! ", "x" * 3000, f"t{turn}."])))
    return rows + rows[::5] + [(99, 0, "user", "Fine.")] * 40


@pytest.mark.parametrize("chunk", [1 << 16, 3])
def test_messy_rows(spark, rng, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rows = messy(rng)
    schema = "conv_id long, turn long, role string, text string, kind string, seq string, `edits` int, `a.b` int"
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], schema).repartition(5)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(queries.op11_conversations(spark, str(tmp_path))) == slow_report(rows)


def test_long_conversation_in_pieces(spark, rng, monkeypatch):
    """One conversation with most rows is cut by order into several partitions and chunks."""
    monkeypatch.setattr(conversations, "CHUNK", 64)
    rows = [(1 if i % 10 else i, i, rng.choice(["user", "assistant", "system"]), rng.choice(["ok.", f"well {i}", ""])) for i in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        repaired = conversations.repair_turns(turns)
        assert len({r["part"] for r in conversations._chunks(conversations._classes(conversations._turns(turns, "conv_id", "turn", "role", "text"))).where("conv = 1").collect()}) > 1
        whole = [r for r in conversations.report(repaired).collect() if r["conv"] == 1][0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen, kinds = set(), []
    for c, _, role, text in rows:
        if c == 1:
            kinds.append((role[0], not text or (role, text) in seen, text[-1:] not in "." ))
            seen.add((role, text))
    import sys

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(100_000)
    try:
        assert (whole["cost"], whole["audit"]) == cheapest(tuple(kinds))
    finally:
        sys.setrecursionlimit(limit)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_conversations(spark, str(tmp_path)).collect() == []
