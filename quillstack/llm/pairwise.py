"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in functions of its statistics; the chance that
a good document is preferred to a bad one is sigmoid(strength - strength), so
the weights minimise the logistic loss on differences of features over
preference pairs.  Each statistic enters by itself and by hinges at its
quantiles, which lets a strength rise and fall with it.

The cut between good and bad is a quantile of the strengths of all labelled
rows that may be learnt from: as many lie below it as are labelled bad, and it
stands midway between the strengths on both sides.  Scores are sigmoids of the distance from the cut, moved so that the cut scores
``THRESHOLD``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality, scratch
from .quality import COUNTS

#: Labelled rows that the fit sees at most.
SAMPLE = 20000
#: Preference pairs that it sees at most: every row meets rows of the other label in turn.
PAIRS = 60000
KNOTS = (0.1, 0.25, 0.5, 0.75, 0.9)
THRESHOLD = 0.3


@dataclass(frozen=True)
class Ranking:
    middle: np.ndarray
    spread: np.ndarray
    knots: np.ndarray
    weights: np.ndarray

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.spread, -8, 8)
        return np.concatenate([z, *(np.maximum(z - k, 0) for k in self.knots)], 1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.weights


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """The statistics' ratios, the squeezed ones stretched near 0 where most documents lie."""
    x = quality.features(c)
    names = list(quality.FEATURES)
    for name in ("symbols", "dup_lines", "repeats", "upper", "digits", "marks"):
        at = names.index(name)
        x[:, at] = np.sqrt(x[:, at])
    x[:, names.index("line_words")] = np.log1p(x[:, names.index("line_words")])
    return x


def _newton(diff: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Weights that minimise the pairs' mean logistic loss and a ridge."""
    w = np.zeros(diff.shape[1])
    loss = lambda w: (weight * np.logaddexp(0, -(diff @ w))).sum() + ridge / 2 * w @ w
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))
        grad = -diff.T @ (weight * p) + ridge * w
        hess = (diff * (weight * p * (1 - p))[:, None]).T @ diff + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w, before, now = w - size * step, now, loss(w - size * step)
        if before - now < 1e-9:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, pairs: int = PAIRS, seed: int = 11) -> Ranking:
    """Strengths from features x and labels y; with one label only, all strengths are 0."""
    middle = np.median(x, 0) if len(x) else np.zeros(x.shape[1])
    spread = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(x.shape[1])
    z = (x - middle) / spread
    knots = np.quantile(z, KNOTS, axis=0) if len(x) else np.zeros((len(KNOTS), x.shape[1]))
    model = Ranking(middle, spread, knots, np.zeros(x.shape[1] * (1 + len(KNOTS))))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    rng = np.random.default_rng(seed)
    n = int(min(pairs, len(good) * len(bad)))
    every = lambda rows: np.concatenate([rng.permutation(rows) for _ in range(-(-n // len(rows)))])[:n]  # noqa: E731  all equally often
    a, b = every(good), every(bad)
    phi = model.basis(x)
    return Ranking(middle, spread, knots, _newton(phi[a] - phi[b], np.full(n, 1 / n), ridge))


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _strengths(rows: DataFrame, model: Ranking, keep: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.strength(features({n: b.column(n).to_numpy().astype(float) for n in COUNTS}))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s)], [*keep, "strength"])

    return rows.mapInArrow(run, ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep), "strength double"]))


def train(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> tuple[Ranking, float]:
    """The ranking and the strength at the cut.

    Only rows outside the held-out fold count.  A key with several labels takes
    the least, of several texts of a key the least statistics count.
    """
    named = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("_y")).where(~held_out("doc_id"))
    learn = scratch.save(stats.join(named, "doc_id").groupBy("doc_id", "_y").agg(F.min(F.struct(*COUNTS)).alias("s")).select("doc_id", "_y", "s.*"), "labelled")
    counts = {r["_y"]: r["n"] for r in learn.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    rows = learn.where(scratch.share("doc_id", sample, total)).toPandas().sort_values("doc_id")
    model = fit(features({c: rows[c].to_numpy(float) for c in COUNTS}), rows["_y"].to_numpy(float))
    if len(counts) < 2:  # all are of one label, or there is none: everything is good but where all are bad
        return model, 1e3 if set(counts) == {0} else -1e3
    sides = [counts[0] / total, min(1.0, (counts[0] + 1) / total)]
    q = _strengths(learn, model, []).agg(F.percentile_approx("strength", sides, 100_000).alias("q")).first()["q"]
    return model, (q[0] + q[1]) / 2


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null texts count as empty, very long ones whole.  Repeated rows score alike;
    null ids are scored and never learnt from.  Without labels of both classes
    every score is about 1, or about 0 where all labels are 0.  An empty table
    gives an empty result; other columns are not read.
    """
    stats = scratch.save(quality.document_statistics(docs, key, text), "statistics")
    model, cut = train(stats, labels, key)
    move = float(np.log(threshold / (1 - threshold)))
    rows = _strengths(stats, model, ["doc_id"])
    value = 1 / (1 + F.exp(F.lit(cut) - F.col("strength") - F.lit(move)))
    return rows.select("doc_id", held_out().alias("held_out"), value.alias("score")).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
