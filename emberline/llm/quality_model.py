"""Quality by hierarchical empirical Bayes.

A logistic model gives each text its own evidence. Sites add theirs: the mean probability of a
host is shrunk toward the global mean, that of a path toward its host's, each the more the fewer
texts it has. How strongly is itself estimated from the spread of the means. Everything but
the model's fit is grouped aggregation over all texts.

Toxic texts are judged in the same way by a second model, whose evidence is the presence of words
that the labelled texts tell apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.common import col, map_batches, staged

#: The model is fitted on so many labelled texts at most.
LABELLED = 20_000
#: Words that the model of toxic texts looks at, at most.
WORDS = 256
#: Bounds of a prior's weight, in texts.
LEAST, MOST = 1.0, 10_000.0

# ---------------------------------------------------------------- evidence


def features(text: str | None) -> np.ndarray:
    """Shares of single bytes, and how varied words and lines are. Any length, empty included."""
    data = (text or "").encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(data))
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    distinct = len(set(words)) / n
    return np.concatenate(
        [
            np.sqrt(counts[:128] / size),
            [
                np.sqrt(counts[128:].sum() / size), upper / max(1.0, upper + lower), np.log1p(len(words)), (len(words) < 50) * 1.0,
                size / n, distinct, distinct * np.log1p(len(words)), len(set(lines)) / max(1, len(lines)),
                len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2),
            ],
        ]
    )


class Logistic:
    """A ridge logistic regression on standardised features, fitted by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = np.column_stack([np.ones(len(x)), self._standard(x)])
        self.weights = np.zeros(z.shape[1])
        rate = (y.sum() + 1) / (len(y) + 2)
        self.weights[0] = np.log(rate / (1 - rate))
        keep = np.eye(z.shape[1]) * ridge
        keep[0, 0] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + keep, z.T @ (y - p) - keep @ self.weights)
            # a step that overshoots is halved until the loss falls
            loss = self._loss(z, y, keep, self.weights)
            while np.abs(step).max() >= 1e-8 and self._loss(z, y, keep, self.weights + step) > loss:
                step /= 2
            self.weights += step
            if np.abs(step).max() < 1e-8:
                break

    @staticmethod
    def _loss(z: np.ndarray, y: np.ndarray, keep: np.ndarray, weights: np.ndarray) -> float:
        odds = z @ weights
        return float(np.logaddexp(0, odds).sum() - y @ odds + weights @ keep @ weights / 2)

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log odds of being good."""
        return np.clip(self.weights[0] + self._standard(x) @ self.weights[1:], -30, 30)


Features = Callable[[str | None], np.ndarray]


def _labelled(labels: DataFrame, id: str, label: str, labelled: int) -> DataFrame:
    """doc_id and y of at most ``labelled`` labels, chosen by a hash of the id."""
    return (
        labels.select(col(id).alias("doc_id"), col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
        .groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    )


def _fit(chosen: DataFrame, features: Features, labelled: int) -> Logistic:
    """The model of ``y`` by the ``features`` of ``text``, of which ``chosen`` has few enough rows."""

    def each(batches):
        for batch in batches:
            x = [features(t).astype("<f4").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], names=["x", "y"])

    rows = map_batches(chosen.select("text", "y"), each, "x binary, y double").limit(labelled).toArrow()
    width = len(features(None))
    if not rows.num_rows:
        return Logistic(np.zeros((1, width)), np.array([0.5]))
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), "<f4").reshape(rows.num_rows, width).astype(float)
    return Logistic(x, rows.column("y").to_numpy())


def fit_model(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", labelled: int = LABELLED) -> Logistic:
    """The model of ``label`` (0 or 1), from at most ``labelled`` labelled texts, chosen by a hash of their id.

    Labels without id or value are left out; an id labelled more than once counts by its mean. Without a
    label there is no evidence: even odds for every text.
    """
    # the chosen labels are no more than ``labelled`` short rows
    given = F.broadcast(_labelled(labels, id, label, labelled))
    chosen = docs.select(col(id).alias("doc_id"), col(text).alias("text")).join(given, "doc_id")
    return _fit(chosen, features, labelled)


_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass(frozen=True)
class Presence:
    """Which of some words a text has."""

    words: tuple[str, ...]

    def __call__(self, text: str | None) -> np.ndarray:
        own = words_of(text)
        return np.array([w in own for w in self.words], float)


def fit_words(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", labelled: int = LABELLED, words: int = WORDS,
) -> tuple[Logistic, Presence]:
    """A model of ``label`` by the words that tell the labelled texts apart: those whose share of positive
    texts is farthest, in deviations, from that of all."""

    def each(batches):
        for batch in batches:
            found = [(w, y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in words_of(t)]
            columns = list(zip(*found, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64())], names=["word", "y"])

    given = F.broadcast(_labelled(labels, id, label, labelled))
    chosen = staged(docs.select(col(id).alias("doc_id"), col(text).alias("text")).join(given, "doc_id").select("text", "y"))
    rate = chosen.agg(F.avg("y")).first()[0] or 0.0
    counts = map_batches(chosen, each, "word string, y double").groupBy("word").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    far = (F.col("s") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)) + 1)
    top = counts.where("n > 1").orderBy(F.desc(F.abs(far)), "word").limit(words).select("word").collect()
    present = Presence(tuple(sorted(r["word"] for r in top)))
    return _fit(chosen, present, labelled), present


def _scored(docs: DataFrame, models: dict[str, tuple[Logistic, Features]], text: str) -> DataFrame:
    """``docs`` with the evidence that each of the ``models`` has, in new columns of their names."""
    at, names = docs.columns.index(text), [*docs.columns, *models]

    def each(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [m.evidence(np.array([f(t) for t in texts])) if texts else np.zeros(0) for m, f in models.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.float64()) for x in found]], names=names)

    return map_batches(docs, each, T.StructType([*docs.schema, *[T.StructField(m, T.DoubleType()) for m in models]]))


# ---------------------------------------------------------------- sites


def _probability(evidence: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-evidence))


def _odds(p: Column) -> Column:
    safe = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(safe / (F.lit(1.0) - safe))


def _weight(groups: DataFrame, toward: Column) -> float:
    """The weight of a prior, by moments: groups (n, s, q: count, sum, sum of squares) vary about ``toward``.

    The mean square distance of group means from what they are shrunk to is the spread between
    groups plus the texts' own variance over n. A wide spread makes the prior light.
    """
    mean, n = F.col("s") / F.col("n"), F.col("n")
    within = F.greatest(F.col("q") / n - mean * mean, F.lit(0.0))
    sums = groups.agg(
        F.sum(n).alias("n"), F.sum(n * (mean - toward) ** 2).alias("between"), F.sum(within).alias("noise"), F.sum(F.col("q")).alias("q"),
        F.sum(n * within).alias("own"),
    ).first()
    if not sums["n"]:
        return MOST
    spread = (sums["between"] - sums["noise"]) / sums["n"]
    own = max(sums["own"] / sums["n"], 1e-9)
    return min(MOST, max(LEAST, own / spread)) if spread > 0 else MOST


def _key(names: tuple[str, ...]) -> Column:
    """A site's name; null parts are a site of their own."""
    return F.to_json(F.struct(*[F.coalesce(F.col(n).cast("string"), F.lit("\u0000")).alias(str(i)) for i, n in enumerate(names)]))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """From ``host``, ``path`` and ``p`` of every text: host and path posteriors (stored), and the global mean."""
    paths = staged(
        scored.groupBy("host", "path").agg(
            F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")
        )
    )
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    whole = hosts.agg((F.sum("s") / F.sum("n")).alias("mean")).first()["mean"]
    whole = 0.5 if whole is None else float(whole)
    light = _weight(hosts, F.lit(whole))
    hosts = staged(hosts.select("host", ((F.lit(light * whole) + F.col("s")) / (F.lit(light) + F.col("n"))).alias("host_posterior")))
    paths = staged(paths.join(hosts, "host"))
    light = _weight(paths, F.col("host_posterior"))
    posterior = (F.lit(light) * F.col("host_posterior") + F.col("s")) / (F.lit(light) + F.col("n"))
    return staged(paths.select("host", "path", "host_posterior", posterior.alias("path_posterior"))), whole


def _models(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, toxic: str, labelled: int) -> dict[str, tuple[Logistic, Features]]:
    found = {"evidence": (fit_model(docs, labels, id, text, label, labelled), features)}
    if toxic in labels.columns:
        found["toxic_evidence"] = fit_words(docs, labels, id, text, toxic, labelled)
    return found


def _final(whole: float, evidence: str = "evidence", path: str = "path_posterior") -> Column:
    return _probability(F.col(evidence) + _odds(F.col(path)) - _odds(F.lit(whole)))


def _with_sites(rows: DataFrame, scores: DataFrame, models: dict) -> tuple[DataFrame, dict[str, Column]]:
    """``rows`` (host, path and the evidence) beside the posteriors of their sites, and by model the final probability.

    ``scores`` has the same columns for all texts and is stored. Rows meet the site tables, which Spark broadcasts if
    they are small and else joins with skew splitting.
    """
    final = {}
    for name in models:
        sites, whole = site_posteriors(scores.select("host", "path", _probability(F.col(name)).alias("p")))
        rows = rows.join(sites.withColumnsRenamed({p: f"{name}_{p}" for p in ("host_posterior", "path_posterior")}), ["host", "path"])
        final[name] = _final(whole, name, f"{name}_path_posterior")
    return rows, final


def _kept(final: dict[str, Column], least: float, most_toxic: float) -> Column:
    good = final["evidence"] >= least
    return good & (final["toxic_evidence"] < most_toxic) if "toxic_evidence" in final else good


def judge(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: tuple[str, ...] = ("source", "lang"), id: str = "doc_id",
    text: str = "text", label: str = "quality", toxic: str = "toxic", least: float = 0.5, most_toxic: float = 0.5, labelled: int = LABELLED,
) -> DataFrame:
    """One row per row of ``docs``: id, evidence, host_posterior, path_posterior, probability, toxic_probability, kept.

    ``evidence`` is the log odds of good quality from the text alone. The posterior odds of its path over the global
    odds are added to it, and texts of a probability of ``least`` or more are kept, unless that of being toxic, found in
    the same way from its words, is ``most_toxic`` or more. Without a column ``toxic`` in ``labels`` nothing is known to
    be toxic: that probability is null. Null hosts or path parts are sites of their own; a null text counts as empty;
    repeated rows are judged alike. Other columns, whatever their names, are not read. Empty in, empty out.
    """
    models = _models(docs, labels, id, text, label, toxic, labelled)
    parts = list(dict.fromkeys([host, *path]))
    narrow = docs.select(col(id).alias("doc_id"), col(text).alias("text"), *[col(c).alias(f"part{i}") for i, c in enumerate(parts)])
    of = {c: f"part{i}" for i, c in enumerate(parts)}
    scored = staged(
        _scored(narrow, models, "text")
        .select("doc_id", *models, _key((of[host],)).alias("host"), _key(tuple(of[c] for c in path)).alias("path"))
    )
    rows, final = _with_sites(scored, scored, models)
    return rows.select(
        F.col("doc_id").alias(id), F.round("evidence", 6).alias("evidence"), F.round("evidence_host_posterior", 6).alias("host_posterior"),
        F.round("evidence_path_posterior", 6).alias("path_posterior"), F.round(final["evidence"], 6).alias("probability"),
        F.round(final.get("toxic_evidence", F.lit(None).cast("double")), 6).alias("toxic_probability"),
        _kept(final, least, most_toxic).alias("kept"),
    )


def drop_low_quality(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: tuple[str, ...] = ("source", "lang"), id: str = "doc_id",
    text: str = "text", label: str = "quality", toxic: str = "toxic", least: float = 0.5, most_toxic: float = 0.5, labelled: int = LABELLED,
) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their own columns.

    Texts are scored a second time beside their row, which needs no shuffle of texts.
    """
    models = _models(docs, labels, id, text, label, toxic, labelled)
    parts = list(dict.fromkeys([host, *path]))
    of = {c: f"part{i}" for i, c in enumerate(parts)}
    packed = docs.select(
        col(text).alias("text"), F.struct(*[col(c) for c in docs.columns]).alias("row"), *[col(c).alias(of[c]) for c in parts]
    )
    keys = [_key((of[host],)).alias("host"), _key(tuple(of[c] for c in path)).alias("path")]
    scores = staged(_scored(packed.drop("row"), models, "text").select(*models, *keys))
    full = _scored(packed, models, "text").select("row", *models, *keys)
    rows, final = _with_sites(full, scores, models)
    return rows.where(_kept(final, least, most_toxic)).select("row.*")
