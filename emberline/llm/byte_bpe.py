"""Byte-level BPE: encoding with vectorised pre-tokenisation, and decoding by offsets.

Texts are split without a regular expression. Each code point gets a class (with a look at the
next one), each class is a transition function over eight states, and functions compose
associatively: all products of them form a small monoid with a multiplication table. A blocked
prefix scan over element numbers gives the state before every code point, and a table says
where a slice begins. Slices go through a bounded cache; what it lacks is merged in lock step,
one merge per slice and round. Token ends are kept, and decoding places bytes by them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from emberline.llm.common import col, map_batches

# ---------------------------------------------------------------- slices

#: Symbols: letter, letter that ends a contraction, first of two that do, number, other,
#: apostrophe, last space of a run, white space before more of it or the end, last other white space.
LETTER, ENDING, HEAD, NUMBER, OTHER, APOSTROPHE, SPACE, MIDDLE, BLANK = range(9)
#: States: nothing open, in letters, in numbers, in others, behind a space that joins what
#: follows, in white space, behind an apostrophe that began a slice, inside a contraction.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINING, IN_BLANKS, QUOTED, INSIDE = range(8)

# The contractions that the pattern splits off.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

#: Code points handled at a time.
WINDOW = 1 << 19


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a slice begins at this code point."""
    if symbol == SPACE:
        return JOINING, True
    if symbol == BLANK:
        return FRESH, True
    if symbol == MIDDLE:
        return IN_BLANKS, state != IN_BLANKS
    if symbol in (LETTER, ENDING, HEAD):
        if state == INSIDE or state == QUOTED and symbol == ENDING:
            return FRESH, False
        if state == QUOTED and symbol == HEAD:
            return INSIDE, False
        return IN_LETTERS, state not in (IN_LETTERS, JOINING)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, JOINING)
    if state in (IN_OTHERS, JOINING, QUOTED):
        return IN_OTHERS, False
    return (QUOTED if symbol == APOSTROPHE else IN_OTHERS), True


def _classes() -> np.ndarray:
    """The symbol of every code point, before a look at the next one."""
    major = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    found = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    found[major == "L"], found[major == "N"] = LETTER, NUMBER
    # Unicode's White_Space: what isspace() has without the four information separators
    found[[c for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]] = BLANK
    found[ord(" ")], found[ord("'")] = SPACE, APOSTROPHE
    found[[ord(c) for c in CONTRACTIONS if len(c) == 1]] = ENDING
    return found


class Slicer:
    """Finds where slices begin. Symbols 0-8 carry on, symbols 9-17 first forget what is open."""

    def __init__(self):
        self.classes = _classes()
        steps = [[_step(s, x) for s in range(8)] for x in range(9)]
        self.begins = np.array([[steps[x][s][1] for x in range(9)] for s in range(8)]).ravel()
        functions = [tuple(n for n, _ in row) for row in steps] + [(row[FRESH][0],) * 8 for row in steps]
        elements = {tuple(range(8)): 0}
        order = [tuple(range(8))]
        for f in order:
            for g in functions:
                product = tuple(g[s] for s in f)
                if product not in elements:
                    elements[product] = len(order)
                    order.append(product)
        self.size = len(order)
        table = np.array(order)
        product_of = {bytes(np.array(f, np.uint8)): i for f, i in elements.items()}
        self.product = np.array(
            [product_of[bytes(table[b][table[a]].astype(np.uint8))] for a in range(self.size) for b in range(self.size)], np.uint16
        )
        self.element = np.array([elements[f] for f in functions], np.uint16)
        self.from_fresh = table[:, FRESH].astype(np.uint8)
        self.heads = [(ord(c[0]), ord(c[1])) for c in CONTRACTIONS if len(c) == 2]

    def _times(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.product.take(a.astype(np.int32) * self.size + b)

    def _scan(self, elements: np.ndarray, width: int = 64) -> np.ndarray:
        """Products of all prefixes, by blocks: scan inside, then over the blocks' totals."""
        n = len(elements)
        blocks = np.zeros((-(-n // width) or 1) * width, np.uint16)  # element 0 changes nothing
        blocks[:n] = elements
        run = np.ascontiguousarray(blocks.reshape(-1, width).T)
        for i in range(1, width):
            run[i] = self._times(run[i - 1], run[i])
        if run.shape[1] > 1:
            before = np.zeros(run.shape[1], np.uint16)
            before[1:] = self._scan(run[-1])[:-1]
            run = self._times(before[None, :], run)
        return run.T.reshape(-1)[:n]

    def symbols(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The symbol of each code point. ``first`` marks those that begin a text."""
        found = self.classes[points]
        follows = np.zeros(len(points), bool)
        follows[:-1] = ~first[1:]
        after = np.empty_like(points)
        after[:-1], after[-1:] = points[1:], 0
        for head, second in self.heads:
            found[(points == head) & (after == second) & follows] = HEAD
        white = (found == SPACE) | (found == BLANK)
        word_next = np.zeros(len(points), bool)
        word_next[:-1] = ~white[1:]
        found[white & ~(word_next & follows)] = MIDDLE
        return found

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Numbers of the code points at which a slice begins."""
        if not len(points):
            return np.zeros(0, np.int64)
        symbol = self.symbols(points, first)
        state = np.empty(len(points), np.uint8)
        state[0], state[1:] = FRESH, self.from_fresh[self._scan(self.element[symbol + 9 * first])[:-1]]
        state[first] = FRESH
        return np.flatnonzero(self.begins[state.astype(np.int16) * 9 + symbol])


# ---------------------------------------------------------------- merges


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a JSON vocabulary: visible Latin-1, then from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


NEVER = np.int32(2**31 - 1)


class TokenTable:
    """The tokens of a byte-level vocabulary, for decoding.

    The file has rank lines (base64, number) or is JSON with vocabulary and merges.
    """

    def __init__(self, content: bytes):
        self.special: dict[str, int] = {}
        self.merges: list[tuple[bytes, bytes]] | None = None
        if content[:1] == b"{":
            model, letters = json.loads(content), _byte_letters()
            read = lambda token: bytes(letters[c] for c in token)
            self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
            self.ids = {read(t): i for t, i in model["model"]["vocab"].items() if t not in self.special}
            self.merges = [tuple(map(read, m if isinstance(m, list) else m.split(" "))) for m in model["model"]["merges"]]
        else:
            self.ids = {base64.b64decode(t): int(i) for t, i in (line.split() for line in content.splitlines() if line)}
        self.vocabulary = max([*self.ids.values(), *self.special.values()]) + 1
        tokens = [b""] * self.vocabulary
        for t, i in [*self.ids.items(), *((t.encode(), i) for t, i in self.special.items())]:
            tokens[i] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.places, self.blob = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """The bytes of ``ids``, each token's put where ``ends`` says it ends."""
        size = self.lengths[ids]
        total = int(ends[-1]) if len(ends) else 0
        if int(size.sum()) != total:
            raise ValueError("these ends are not of these ids")
        return self.blob[np.repeat(self.places[ids] - (ends.astype(np.int64) - size), size) + np.arange(total)].tobytes()


class ByteBpe(TokenTable):
    """A byte-level vocabulary with all that encoding needs.

    Rank lines name no merges: two neighbours merge if their bytes together have a rank. A JSON
    file's special tokens are single tokens wherever a text has them.
    """

    #: Limits of the cache: slices, and ids in them. Beyond one, the cache begins anew.
    CACHED, HELD = 250_000, 4 << 20

    def __init__(self, content: bytes):
        super().__init__(content)
        ids = self.ids
        if self.merges is None:
            merges = [
                (ids[t[:i]], ids[t[i:]], n)
                for t, n in sorted(ids.items(), key=lambda x: x[1])
                for i in range(1, len(t))
                if t[:i] in ids and t[i:] in ids
            ]
            self.whole = ids
        else:
            merges = [(ids[a], ids[b], ids[a + b]) for a, b in self.merges]
            self.whole: dict[bytes, int] = {}
        self.merges = None
        self.slicer = Slicer()
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        left, right, made = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        # pairs of rank lines that make the same token are equally urgent
        rank = np.unique(made, return_inverse=True)[1] if self.whole else np.arange(len(made))
        self.made = np.zeros(rank.max() + 1, np.int32)
        self.made[rank] = made
        key = left * self.vocabulary + right
        self.rank_of = dict(zip(key.tolist(), rank.tolist(), strict=True))
        self._fill(key, rank.astype(np.int32))
        self._forget()

    def _forget(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.flat, self.at, self.count, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, key: np.ndarray, rank: np.ndarray) -> None:
        """A hash table of pairs, at most a quarter full, for looking up many at once."""
        self.bits = int(len(key) * 4).bit_length()
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER, np.int32)
        key, place = np.unique(key, return_index=True)
        rank, slot = rank[place], self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] < 0)
            self.keys[slot[free]] = key[free]  # of several, one stays
            left = self.keys[slot] != key
            self.ranks[slot[~left]] = rank[~left]
            key, rank, slot = key[left], rank[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.vocabulary + right
        key[right < 0] = -2
        slot = self._slot(key)
        met = self.keys[slot]
        found = np.where(met == key, self.ranks[slot], NEVER)
        more = np.flatnonzero((met != key) & (met >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & ((1 << self.bits) - 1)
            met = self.keys[slot[more]]
            hit = met == key[more]
            found[more[hit]] = self.ranks[slot[more[hit]]]
            more = more[~hit & (met >= 0)]
        return found

    def _merge_together(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many for each of ``pieces`` of at most ``width`` bytes: one merge a round in each."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        part = np.full((len(pieces), width + 1), -1, np.int32)
        part[np.arange(width + 1)[None, :] < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, width + 2, dtype=np.int8), (len(pieces), 1))
        before = after - np.int8(2)
        rank = np.full((len(pieces), width + 1), NEVER, np.int32)
        r, c = np.nonzero(part[:, 1:] >= 0)
        rank[r, c] = self._ranks(part[r, c], part[r, c + 1])
        rows = np.arange(len(pieces))
        while True:
            lowest = rank[rows].argmin(axis=1)
            best = rank[rows, lowest]
            live = best != NEVER
            rows, lowest, best = rows[live], lowest[live], best[live]
            if not len(rows):
                break
            gone = after[rows, lowest]
            beyond = after[rows, gone]
            part[rows, lowest], part[rows, gone] = self.made[best], -1
            after[rows, lowest], rank[rows, gone] = beyond, NEVER
            before[rows, np.minimum(beyond, width)] = lowest
            inside = beyond <= width
            right = np.where(inside, part[rows, np.minimum(beyond, width)], -1)
            rank[rows, lowest] = self._ranks(self.made[best], right)
            left = before[rows, lowest]
            has = left >= 0
            rank[rows[has], left[has]] = self._ranks(part[rows[has], left[has]], self.made[best[has]])
        done = part >= 0
        return part[done], done.sum(axis=1)

    def _merge_long(self, piece: bytes) -> list[int]:
        """The ids of one long slice, by a heap of neighbours."""
        part: list[int] = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def push(i: int, j: int) -> None:
            if i >= 0 and j < n and (rank := self.rank_of.get(part[i] * self.vocabulary + part[j])) is not None:
                heapq.heappush(heap, (rank, i, j, part[i], part[j]))

        heap: list = []
        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            rank, i, j, a, b = heapq.heappop(heap)
            if part[i] != a or j >= n or after[i] != j or part[j] != b:
                continue
            part[i], part[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i], i)
            push(i, after[i])
        return [p for p in part if p >= 0]

    def _learn(self, pieces: list[bytes]) -> None:
        """Put the ids of new, different ``pieces`` into the cache."""
        known = [p for p in pieces if p in self.whole]
        self._hold(known, np.array([self.whole[p] for p in known], np.int32), np.ones(len(known), np.int64))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        size[[p in self.whole for p in pieces]] = -1
        for low, width in ((0, 8), (8, 16), (16, 32), (32, 64), (64, 0)):
            some = [pieces[i] for i in np.flatnonzero((size > low) & ((size <= width) | (width == 0))).tolist()]
            for i in range(0, len(some), 8192):
                few = some[i : i + 8192]
                if width:
                    ids, counts = self._merge_together(few, width)
                else:
                    each = [self._merge_long(p) for p in few]
                    ids, counts = np.array([x for e in each for x in e], np.int32), np.array([len(e) for e in each])
                self._hold(few, ids, counts)

    def _hold(self, pieces: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.cache)
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.at) < n + len(pieces):
            self.at, self.count = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.count, np.zeros_like(self.count)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[n : n + len(pieces)] = self.used + np.cumsum(counts) - counts
        self.count[n : n + len(pieces)] = counts
        self.used += len(ids)
        self.cache.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def _pieces(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slices of ``data`` that begin at ``starts``, in a row, and how many each has."""
        if len(self.cache) > self.CACHED or self.used > self.HELD:
            self._forget()
        chosen, like = self._different(data, starts)
        ends = np.append(starts[1:], len(data))
        pieces = [data[a:b] for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist(), strict=True)]
        found = np.fromiter(map(self.cache.get, pieces, repeat(-1)), np.int64, len(pieces))
        lacking = np.flatnonzero(found < 0)
        if len(lacking):
            new = [pieces[i] for i in lacking.tolist()]
            self._learn(list(dict.fromkeys(new)))
            found[lacking] = np.fromiter(map(self.cache.__getitem__, new), np.int64, len(new))
        found = found[like]
        counts = self.count[found]
        ends = np.cumsum(counts)
        ids = self.flat[np.repeat(self.at[found] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, counts

    @staticmethod
    def _different(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of slices that stand for all, and for each slice the place of its like in these.

        Slices of up to 16 bytes are two words; their mix sorts like ones together, and each is
        compared in full with the one that is to stand for it. Others stand for themselves.
        """
        size = np.diff(np.append(starts, len(data)))
        padded = np.frombuffer(data + bytes(16), np.uint8)
        words = np.ndarray((len(data) + 9,), np.dtype("<u8"), padded, strides=(1,))
        bits = np.minimum(size, 8).astype(np.uint64) * np.uint64(8)
        low = words[starts] & (~np.uint64(0) >> (np.uint64(64) - bits))
        bits = np.clip(size - 8, 0, 8).astype(np.uint64) * np.uint64(8)
        high = np.where(bits > 0, words[starts + 8] & (~np.uint64(0) >> np.minimum(np.uint64(64) - bits, np.uint64(63))), np.uint64(0))
        mix = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F)) ^ size.astype(np.uint64)
        _, chosen, like = np.unique(mix, return_index=True, return_inverse=True)
        other = chosen[like]
        alone = np.flatnonzero((low != low[other]) | (high != high[other]) | (size != size[other]) | (size > 16))
        like[alone] = len(chosen) + np.arange(len(alone))
        return np.concatenate([chosen, alone]), like

    def _ordinary(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` in a row, and how many each has; together at most about a window."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points) + 1, bool)
        first[np.cumsum(sizes) - sizes] = True  # an empty text marks the next one's beginning, or the end
        starts = self.slicer.starts(points, first[:-1])
        ids, counts = self._pieces(*self._cut(joined, points, starts))
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(ends[np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))])

    @staticmethod
    def _cut(joined: str, points: np.ndarray, starts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """UTF-8 bytes, and the bytes at which the slices begin."""
        data = joined.encode()
        if len(data) > len(points):
            width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            starts = (np.cumsum(width) - width)[starts]
        return data, starts

    def _very_long(self, text: str) -> np.ndarray:
        """Ids of one text of over a window, window by window: each ends where a slice surely begins."""
        parts, at, span = [], 0, WINDOW
        while at < len(text):
            piece = text[at : at + span]
            points = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
            first = np.zeros(len(points), bool)
            first[0] = True
            starts = self.slicer.starts(points, first)
            if at + span < len(text):
                starts = starts[starts < len(piece) - 3]  # what follows may change the last few
                if len(starts) < 2:  # one slice fills the window
                    span *= 2
                    continue
                piece, starts = piece[: starts[-1]], starts[:-1]
                points = points[: len(piece)]
            parts.append(self._pieces(*self._cut(piece, points, starts))[0])
            at, span = at + len(piece), WINDOW
        return np.concatenate(parts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` in a row (int32), and how many each text has."""
        if any(s in t for s in self.special for t in texts):
            return self._with_special(texts)
        out, counts, few, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [], 0

        def flush():
            nonlocal few, size
            if few:
                ids, n = self._ordinary(few)
                out.append(ids)
                counts.append(n)
            few, size = [], 0

        for text in texts:
            if len(text) > WINDOW:
                flush()
                out.append(self._very_long(text))
                counts.append(np.array([len(out[-1])]))
                continue
            if size + len(text) > WINDOW:
                flush()
            few.append(text)
            size += len(text)
        flush()
        return np.concatenate(out), np.concatenate(counts)

    def _with_special(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for text in texts:
            parts: list = [text]
            for s, i in self.special.items():
                parts = [x for p in parts for x in ([p] if isinstance(p, int) else _between(p.split(s), i))]
            out.append(np.concatenate([np.zeros(0, np.int32), *(
                np.array([p], np.int32) if isinstance(p, int) else self._plain(p) for p in parts if p != ""
            )]))
        return np.concatenate([np.zeros(0, np.int32), *out]), np.array([len(x) for x in out], np.int64)

    def _plain(self, text: str) -> np.ndarray:
        return self._very_long(text) if len(text) > WINDOW else self._ordinary([text])[0]


def _between(parts: list, mark: int) -> list:
    return [x for p in parts for x in (mark, p)][1:]


# ---------------------------------------------------------------- DataFrames

#: What this Python worker has built, by the file's digest and kind.
_LOADED: dict[tuple[str, type], TokenTable] = {}


class Vocabulary:
    """A vocabulary file (a megabyte or two, whatever the data), broadcast and built once a worker."""

    def __init__(self, df: DataFrame, path: str):
        with open(path, "rb") as file:
            content = file.read()
        self.digest = hashlib.sha1(content).hexdigest()
        self.content = df.sparkSession.sparkContext.broadcast(content)

    def load(self, kind: type = ByteBpe):
        if (self.digest, kind) not in _LOADED:
            _LOADED.clear()
            _LOADED[self.digest, kind] = kind(self.content.value)
        return _LOADED[self.digest, kind]


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow array of binaries: ``counts`` items of ``data`` each."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def encode_documents(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ids, ends.

    ``ids`` are the text's tokens, ``ends`` the byte at which each ends, both as little-endian unsigned
    32-bit integers. A null or empty text has none. Other columns, whatever their names, are not
    read; repeated rows are encoded alike; empty in, empty out.
    """
    known = Vocabulary(docs, vocabulary)

    def each(batches: Iterator[pa.RecordBatch]):
        bpe = known.load()
        for batch in batches:
            ids, counts = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
            total = np.cumsum(bpe.lengths[ids])
            before = np.concatenate([[0], total])[np.cumsum(counts) - counts]
            ends = (total - np.repeat(before, counts)).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), binaries(ids.astype("<u4"), counts), binaries(ends, counts)], names=[id, "ids", "ends"]
            )

    narrow = docs.select(col(id), col(text))
    out = T.StructType([narrow.schema[0], T.StructField("ids", T.BinaryType()), T.StructField("ends", T.BinaryType())])
    return map_batches(narrow, each, out)


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` with a column ``decoded`` (binary) of the bytes that its ``ids`` and ``ends`` stand for."""
    known = Vocabulary(encoded, vocabulary)
    base = encoded.drop("decoded")
    names = [*base.columns, "decoded"]
    ids_at, ends_at = names.index("ids"), names.index("ends")

    def each(batches: Iterator[pa.RecordBatch]):
        tokens = known.load(TokenTable)
        for batch in batches:
            decoded = [
                tokens.decode(np.frombuffer(i or b"", "<u4"), np.frombuffer(e or b"", "<u4"))
                for i, e in zip(batch.column(ids_at).to_pylist(), batch.column(ends_at).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=names)

    return map_batches(base, each, T.StructType([*base.schema, T.StructField("decoded", T.BinaryType())]))
