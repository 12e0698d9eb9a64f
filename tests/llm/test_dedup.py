"""Exact and near duplicates, and repeated lines."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from emberline.llm import components, exact_dedup, line_dedup, queries, shingles, simhash
from tests.llm.conftest import LONG, PROSE, ROWS, SF_DIR, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def order(i):
    return (i is not None, i or 0)


def check_copies(rows, given):
    groups = {}
    for i, t in given:
        groups.setdefault(t or "", []).append(i)
    expected = Counter((i, max(groups[t or ""], key=order), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in given)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == expected
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_query(spark, given):
    check_copies(queries.op7_exact_dedup(spark, SF_DIR).collect(), given)


@pytest.mark.parametrize("counters", [1, 2, 256])
def test_exact_edges(messy, counters):
    check_copies(exact_dedup.mark_copies(messy, counters=counters).collect(), ROWS)
    assert exact_dedup.mark_copies(messy.limit(0), counters=counters).count() == 0


def test_exact_rows_that_stay(messy):
    kept = exact_dedup.drop_copies(messy)
    assert kept.columns == messy.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({t or "" for _, t in ROWS})
    assert exact_dedup.drop_copies(messy.limit(0)).count() == 0


def test_frequent_digests_are_found_and_few(spark, rng):
    values = ["hot"] * 4000 + [f"v{rng.randint(0, 3000)}" for _ in range(8000)]
    rng.shuffle(values)
    rows = spark.createDataFrame([(v,) for v in values], "digest string").repartition(7)
    found = [r["digest"] for r in exact_dedup.frequent(rows, "digest", 10).collect()]
    assert "hot" in found and len(found) <= 11


def slow_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, points, radius):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    smallest = {}
    for i, x in enumerate(ids):
        r = root(i)
        smallest[r] = x if smallest.get(r) is None else min(smallest[r], smallest[r] if x is None else x)
    return [smallest[root(i)] for i in range(len(ids))]


def check_near(rows, given, radius=2):
    points = [slow_fingerprint(t) for _, t in given]
    found = slow_components([i for i, _ in given], points, radius)
    expected = Counter((i, f"{p:016x}", c) for (i, _), p, c in zip(given, points, found, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == expected


def test_near_query(spark, given):
    check_near(queries.op3_simhash(spark, SF_DIR).collect(), given)


def test_near_edges(messy):
    check_near(simhash.mark_near_copies(messy).collect(), ROWS)
    assert simhash.mark_near_copies(messy.limit(0)).count() == 0


def test_near_rows_that_stay(messy):
    kept = simhash.drop_near_copies(messy)
    assert kept.columns == messy.columns
    points = [slow_fingerprint(t) for _, t in ROWS]
    expected = set(slow_components([i for i, _ in ROWS], points, 2))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(expected)
    assert simhash.drop_near_copies(messy.limit(0)).count() == 0


def test_near_rows_without_an_id_of_their_own_stay(spark):
    other = "The harbour master counted nine grey ships before noon and wrote each name into a narrow ledger."
    third = "Seventy kilometres of copper wire lay coiled behind the workshop until spring came."
    rows = [(None, PROSE), (None, PROSE), (None, other), (None, third), (5, PROSE + " x1"), (5, other + " x2"), (5, third + " x3"), (6, LONG)]
    points = [slow_fingerprint(t) for _, t in rows]
    labels = slow_components(points, points, 2)
    kept = [(r["doc_id"], r["text"]) for r in simhash.drop_near_copies(documents(spark, rows)).collect()]
    assert len(set(labels)) == 7 and len(kept) == 7
    assert sorted(labels[rows.index(r)] for r in kept) == sorted(set(labels))


@pytest.mark.parametrize(("leaf", "block"), [(16, 24), (64, 4096)])
def test_tree_loses_no_link(spark, rng, monkeypatch, leaf, block):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash.fit_tree, "__defaults__", (leaf, 6))
    points = [rng.getrandbits(64) for _ in range(600)]
    for p in points[:150]:  # close ones, chains, and one dense ball
        points.append(p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    points += [points[0] ^ 1 << a ^ 1 << b for a in range(12) for b in range(a)]
    points = sorted(set(points))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    classes = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(5)
    labels = {r["node"]: r["label"] for r in components.connected_components(simhash.links(classes, 2)).collect()}
    expected = slow_components(signed, points, 2)
    assert [labels.get(p, p) for p in signed] == expected


def test_tree_prunes(rng):
    sample = np.array([rng.getrandbits(64) for _ in range(4000)], np.uint64)
    leaves, who = simhash.fit_tree(sample, len(sample), 2, leaf=256).deal(sample, 2)
    sizes = Counter(leaves.tolist())
    assert sum(n * n for n in sizes.values()) < len(sample) ** 2 / 3 and len(who) < 5 * len(sample)


def slow_similar(texts, k=5):
    """For each text the first text that links of Jaccard similarity 0.8 reach."""
    sets = []
    for t in texts:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def check_similar(rows, given):
    label = slow_similar([t for _, t in given])
    smallest = {}
    for x, (i, _) in zip(label, given, strict=True):
        if x not in smallest or smallest[x] is None or (i is not None and i < smallest[x]):
            smallest[x] = i
    texts = {}
    for x, (i, t) in zip(label, given, strict=True):
        texts.setdefault((i, t), x)
    assert Counter((texts[r["doc_id"], r["text"]], r["doc_id"]) for r in rows) == Counter(smallest.items())


def test_similar_rows_that_stay(messy):
    kept = shingles.drop_similar(messy)
    assert kept.columns == messy.columns
    check_similar(kept.collect(), ROWS)
    assert shingles.drop_similar(messy.limit(0)).count() == 0


def test_near_stage_drops_what_is_similar_and_no_more(spark, rng):
    """Edited copies on both sides of 0.8, chains and a group without a common centre; null and repeated ids."""
    rows, base = [], None
    for n in range(240):
        if n % 8 == 0 or base is None:
            base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 120, 300)))]
        words = list(base)
        for _ in range(rng.randrange(0, len(words) // 16)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        base = words if n % 3 == 0 else base
        rows.append((None if n % 7 == 0 else n % 200, " ".join(words)))
    given = sorted(set(rows), key=rows.index)
    kept = corpus_pipeline.near_stage(spark, documents(spark, given), SF_DIR).collect()
    check_similar(kept, given)
    points = [slow_fingerprint(t) for _, t in given]
    assert 40 < len(kept) < len(set(slow_components(points, points, 2)))


def test_near_stage_drops_what_simhash_links(spark, rng):
    """Texts with few shingles in common, but within two bits; links of both kinds chain."""
    line = " ".join(f"w{rng.randrange(5000)}" for _ in range(31))

    def tail(n):
        return " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))

    # a line repeated often settles the votes, while most of the different shingles are those of the tails
    voted = [" ".join([line] * 400 + [tail(120)]) for _ in range(4)]
    plain = [tail(100) for _ in range(20)]
    far = " ".join([*[line] * 3, voted[0].split(line)[-1]])  # similar to the first, but many bits away
    texts = [*voted, *plain, far, far.replace("w", "v", 2)]
    points, similar = [slow_fingerprint(t) for t in texts], slow_similar(texts)
    near = slow_components(list(range(len(texts))), points, 2)
    assert near[:4] == [0] * 4 and similar[:4] == [0, 1, 2, 3]
    assert near[-2] != 0 and similar[-2] == 0
    kept = corpus_pipeline.near_stage(spark, documents(spark, list(enumerate(texts))), SF_DIR).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, *range(4, len(texts) - 2)]


def slow_runs(given, least):
    """Lines that later repeated runs cover, by (id, text)."""
    docs = sorted({(i, t or "") for i, t in given}, key=lambda d: order(d[0]))
    seen, gone = {}, {d: set() for d in docs}
    for d in docs:
        lines = [(n, x) for n, x in enumerate(d[1].split("\n")) if WORD.search(x)]
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += len(WORD.findall(lines[b][1]))
                if words >= least:
                    content = tuple(x for _, x in lines[a : b + 1])
                    origin = seen.setdefault(content, (d, lines[a][0], lines[b][0]))
                    if origin[:2] != (d, lines[a][0]):
                        begin = max(lines[a][0], origin[2] + 1) if origin[0] == d else lines[a][0]
                        gone[d].update(range(begin, lines[b][0] + 1))
                    break
    return gone


def check_lines(rows, given, least):
    gone, expected = slow_runs(given, least), Counter()
    for i, t in given:
        lost, lines = gone[i, t or ""], (t or "").split("\n")
        text = t if not lost else "\n".join(x for n, x in enumerate(lines) if n not in lost)
        expected[i, len(lines), len(lost), text] += 1
    assert Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in rows) == expected


def test_line_query(spark, given):
    check_lines(queries.op5_line_dedup(spark, SF_DIR).collect(), given, 50)


def test_line_edges(spark, messy, rng):
    check_lines(line_dedup.delete_repeated_runs(messy, min_words=5).collect(), ROWS, 5)
    assert line_dedup.delete_repeated_runs(messy.limit(0)).count() == 0
    lines = ["a b", "c", "d e f", "", " ", "g h", "i", "j k l m n o p q"]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 25)))) for i in range(60)]
    for least in (1, 4, 9):
        check_lines(line_dedup.delete_repeated_runs(documents(spark, rows), min_words=least).collect(), rows, least)
