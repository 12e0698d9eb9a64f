"""Quality rules as a short-circuit cascade.

Each rule measures a text and may reject it. On a bounded sample the operator takes each rule's
cost and which texts it rejects, and orders the rules by rejection per cost, each given what
the rules before it have left. A text is then measured only until the first rejection. The order
changes the cost, never the verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from emberline.llm.common import col, map_batches

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Bytes that begin no code point of a word: white space, and the later bytes of a code point.
NOT_COUNTED = WHITE + bytes(range(0x80, 0xC0))
_WORD = re.compile(rb"[^\x20\x09-\x0D]")
_BLANKS = re.compile(r"[\x20\x09-\x0D]+")
#: Rows of the sample that the order of the rules is taken from.
SAMPLE_ROWS = 2000


class Measured:
    """A text and its measures, each taken when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.data = self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.data.translate(None, NOT_COUNTED))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.data.split(b"\n") if _WORD.search(line)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that the text has twice or more, the first included."""
        w = self.words
        seen: set = set()
        again = {g for g in zip(w, w[1:], w[2:], strict=False) if g in seen or seen.add(g)}
        if not again:
            return 0
        total = reached = 0
        for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)):
            if g in again:
                total += i + 3 - max(i, reached)
                reached = i + 3
        return total

    @cached_property
    def shouting(self) -> int:
        """Words of two or more letters without a lower-case one."""
        return sum(len(w) > 1 and w.isupper() for w in _BLANKS.split(self.text))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measured], bool]


#: The rules that every text must pass whatever the others say.
BASE = (
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
)
#: All production rules.
RULES = (
    *BASE,
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 15 * m.n_words),
    Rule("repeated_lines", lambda m: m.n_dup_lines > 2 and 2 * m.n_dup_lines > len(m.lines)),
    Rule("shouting", lambda m: 100 * m.shouting > 50 * m.n_words),
)


def _trial(rules: tuple[Rule, ...]):
    def each(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                mask, spent = 0, []
                for i, rule in enumerate(rules):
                    measured = Measured(text)  # afresh, so that each rule pays for what it needs
                    began = time.perf_counter()
                    mask |= rule.rejects(measured) << i
                    spent.append(time.perf_counter() - began)
                yield pa.RecordBatch.from_arrays([pa.array([mask]), pa.array([spent])], names=["mask", "spent"])

    return each


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """``rules`` by rejection per cost on the first ``sample_rows`` rows that ``docs`` yields.

    Executors measure as many partitions as that takes, one at first; the driver gets a few
    numbers a row. Greedy: the next rule is the one that rejects most, per second, of what is
    still left. Ties and rules that reject nothing keep their given order, as they do for an
    empty table.
    """
    if len(rules) > 62:
        raise ValueError("at most 62 rules")
    trial = map_batches(docs.select(col(text)), _trial(rules), "mask long, spent array<double>").limit(sample_rows).collect()
    cost = [sum(r["spent"][i] for r in trial) for i in range(len(rules))]
    left = Counter(r["mask"] for r in trial)
    order, rest = [], list(range(len(rules)))
    while rest:
        gain = {i: sum(n for m, n in left.items() if m >> i & 1) / max(cost[i], 1e-9) for i in rest}
        best = max(rest, key=lambda i: (gain[i], -i))
        order.append(rules[best])
        rest.remove(best)
        left = Counter({m: n for m, n in left.items() if not m >> best & 1})
    return tuple(order)


def first_rejection(text: str | None, rules: tuple[Rule, ...]) -> str | None:
    measured = Measured(text)
    return next((rule.name for rule in rules if rule.rejects(measured)), None)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """One row per row of ``docs``: id, the base measures, base_failed, kept.

    Words are runs of other than ASCII white space; a null text has none. The base measures are
    reported for every text; the other rules are asked in cascade order, and only of texts that
    passed the base rules. Repeated rows are judged alike; other columns are not read; empty
    in, empty out.
    """
    base, order = tuple(r for r in rules if r in BASE), order_rules(docs, rules, text, sample_rows)
    more = tuple(r for r in order if r not in base)

    def each(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in (*MEASURES, "base_failed", "kept")}
            for value in batch.column(1).to_pylist():
                m = Measured(value)
                for k in MEASURES:
                    out[k].append(getattr(m, k))
                failed = any(rule.rejects(m) for rule in base)
                out["base_failed"].append(failed)
                out["kept"].append(not failed and not any(rule.rejects(m) for rule in more))
            kinds = [pa.int64()] * len(MEASURES) + [pa.bool_()] * 2
            arrays = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id, *out])

    narrow = docs.select(col(id), col(text))
    fields = [T.StructField(k, T.LongType()) for k in MEASURES] + [T.StructField(k, T.BooleanType()) for k in ("base_failed", "kept")]
    return map_batches(narrow, each, T.StructType([narrow.schema[0], *fields]))


def drop_rejected(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, each text measured until the first rejection."""
    order, at = order_rules(docs, rules, text, sample_rows), docs.columns.index(text)

    def each(batches):
        for batch in batches:
            yield batch.filter(pa.array([first_rejection(t, order) is None for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_batches(docs, each, docs.schema)
