"""Toxicity scores by a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

x_i says whether a hashed term occurs in the text; the factors v give each pair
of terms a weight of its own, so an insult next to a mention of a group can
weigh more than both alone.  Terms are lower-cased runs of letters (ASCII, and
all other characters beyond it) and the beginnings of the longer ones.  The
machine is fitted on about ``SAMPLE`` labelled rows of each class at most
(chosen by a hash of their ids), with every term that they hold, in two ways:

* an L1 penalty of ``LAMBDA`` standard errors a term lets most weights be 0;
  weights and factors of the others are then fitted together;
* factors of all terms by stochastic gradients, in turns with the L1 weights,
  which finds pairs neither of whose terms says anything alone.

What a fifth of the labelled rows, kept back, is explained better by is fitted
again on all of them and scores every whole text where Spark reads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textscan import LOWER_ASCII, U, lookup, span_hash, text_chunks

#: Labelled rows of each class that the fit sees at most.
SAMPLE = 4000
BUCKETS = 1 << 20
#: Standard errors that a term's gradient must exceed before its weight leaves 0.
LAMBDA = 2.5
FACTORS = 8
#: A longer word's first so many bytes are terms too: inflected forms share them.
STEMS = (4, 5, 6)
THRESHOLD = 0.3
#: bias, weights, factors
Parameters = tuple[float, np.ndarray, np.ndarray]
_TERM = np.zeros(256, bool)
_TERM[97:123] = _TERM[128:] = True


def term_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """row and hashed bucket of every term of every row, each pair once."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = lookup(LOWER_ASCII, data)
    inside = lookup(_TERM, low)
    before, after = np.ones(len(low), bool), np.ones(len(low), bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    edge = offs[(offs > 0) & (offs < len(low))]
    before[edge] = after[edge - 1] = True
    start, end = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    row = np.searchsorted(offs, start, "right") - 1
    parts = [np.unique(row * BUCKETS + (span_hash(low, start, end) % U(BUCKETS)).astype(np.int64))]
    for n in STEMS:
        long = end - start > n
        stem = span_hash(low, start[long], start[long] + n) ^ U(n)
        parts.append(np.unique(row[long] * BUCKETS + (stem % U(BUCKETS)).astype(np.int64)))
    pair = np.unique(np.concatenate(parts))
    return pair // BUCKETS, pair % BUCKETS


class Machine:
    def __init__(self, feature: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.feature, self.bias, self.w, self.v = feature, bias, w, v

    def margin(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        out = self.bias + np.bincount(row, self.w[term], rows)
        for f in range(self.v.shape[1]):
            x = self.v[term, f]
            out += 0.5 * (np.bincount(row, x, rows) ** 2 - np.bincount(row, x * x, rows))
        return out

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        row, bucket = term_buckets(data, offs)
        term = self.feature[bucket]
        known = term >= 0
        return sigmoid(self.margin(row[known], term[known], len(offs) - 1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _renumbered(values: np.ndarray, kept: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``kept`` of the values (below n) that are in it, and which those are."""
    new = np.full(n, -1, np.int32)
    new[kept] = np.arange(len(kept), dtype=np.int32)
    place = new[values]
    keep = place >= 0
    return place[keep], keep


class _Sample:
    """Labelled rows: (row, term) pairs sorted by row, with terms numbered from 0, and weights that balance the classes.

    The pairs, some hundreds a row, are what the driver holds most of: 32 bits are enough for either.
    """

    def __init__(self, row: np.ndarray, term: np.ndarray, terms: int, y: np.ndarray):
        self.row, self.term = row.astype(np.int32, copy=False), term.astype(np.int32, copy=False)
        self.terms, self.y, self.n = terms, y, len(y)
        ones = y.sum()
        self.weight = np.where(y == 1, 0.5 / max(ones, 1), 0.5 / max(self.n - ones, 1))

    def take(self, rows: np.ndarray) -> _Sample:
        row, keep = _renumbered(self.row, rows, self.n)
        return _Sample(row, self.term[keep], self.terms, self.y[rows])

    def only(self, terms: np.ndarray) -> _Sample:
        term, keep = _renumbered(self.term, terms, self.terms)
        return _Sample(self.row[keep], term, len(terms), self.y)

    def linear(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.term], self.n)

    def pairs(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for f in range(v.shape[1]):
            x = v[self.term, f]
            out += 0.5 * (np.bincount(self.row, x, self.n) ** 2 - np.bincount(self.row, x * x, self.n))
        return out

    def loss(self, margin: np.ndarray) -> float:
        return float((self.weight * np.logaddexp(0, np.where(self.y == 1, -margin, margin))).sum())


def _descend(s: _Sample, w: np.ndarray, b: float, penalty: np.ndarray, offset: np.ndarray, ridge: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradients (FISTA, with a step per term) of the balanced loss + penalty |w|."""
    wide = np.sqrt(np.bincount(s.row, minlength=s.n).max() + 1)
    size, size_b = 0.25 * wide * np.bincount(s.term, s.weight[s.row], s.terms) + ridge + 1e-9, 0.25 * wide
    z, zb, t = w.copy(), b, 1.0
    for _ in range(steps):
        d = (sigmoid(offset + zb + s.linear(z)) - s.y) * s.weight
        go = z - (np.bincount(s.term, d[s.row], s.terms) + ridge * z) / size
        new, new_b = np.sign(go) * np.maximum(np.abs(go) - penalty / size, 0), zb - d.sum() / size_b
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / later * (new - w), new_b + (t - 1) / later * (new_b - b)
        w, b, t = new, new_b, later
    return w, b


def _sparse_weights(s: _Sample, offset: np.ndarray, rounds: int = 20, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights of all terms under the L1 penalty: terms whose gradient exceeds theirs come in, round by round, until none is left outside."""
    share = np.bincount(s.term, s.weight[s.row], s.terms)
    n1 = max(s.y.sum(), 1)
    penalty = LAMBDA / 4 * np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / max(s.n - n1, 1)))
    w, active = np.zeros(s.terms), np.zeros(s.terms, bool)
    _, b = _descend(s.only(np.zeros(0, int)), np.zeros(0), 0.0, np.zeros(0), offset)
    for _ in range(rounds):
        d = (sigmoid(offset + b + s.linear(w)) - s.y) * s.weight
        more = (np.abs(np.bincount(s.term, d[s.row], s.terms)) > 1.05 * penalty) & ~active
        if not more.any():
            break
        active |= more
        at = np.flatnonzero(active)
        w[at], b = _descend(s.only(at), w[at], b, penalty[at], offset, steps=steps)
    return w, b


def _joint(s: _Sample, seed: int, steps: int = 300, l1: float = 2e-5, l2: float = 1e-3) -> Parameters:
    """Weights and factors of the terms of s together (Adam)."""
    n = max(1, s.terms)
    theta = np.concatenate([[0.0], np.zeros(n), np.random.default_rng(seed).normal(0, 0.02, n * FACTORS)])
    m, q = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, v = theta[1 : 1 + n], theta[1 + n :].reshape(n, FACTORS)
        d = (sigmoid(theta[0] + s.linear(w) + s.pairs(v)) - s.y) * s.weight
        grad = np.empty_like(theta)
        grad[0] = d.sum()
        grad[1 : 1 + n] = np.bincount(s.term, d[s.row], n) + l1 * np.sign(w)
        gv = np.empty((n, FACTORS))
        for f in range(FACTORS):
            x = v[s.term, f]
            gv[:, f] = np.bincount(s.term, d[s.row] * (np.bincount(s.row, x, s.n)[s.row] - x), n) + l2 * v[:, f]
        grad[1 + n :] = gv.ravel()
        m, q = 0.9 * m + 0.1 * grad, 0.99 * q + 0.01 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-7)
    return float(theta[0]), theta[1 : 1 + n], theta[1 + n :].reshape(n, FACTORS)


def _batches(s: _Sample, size: int, rng: np.random.Generator) -> list[tuple[np.ndarray, ...]]:
    """Rows, then per (row, term) pair its place in the batch and its term, the order by term, the distinct terms and where each begins."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(s.row, minlength=s.n))])
    order, out = rng.permutation(s.n), []
    for a in range(0, s.n, size):
        rows = np.sort(order[a : a + size])
        n = np.diff(ends)[rows]
        at = np.repeat(ends[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        by_term = np.argsort(s.term[at], kind="stable").astype(np.int32)
        terms, first = np.unique(s.term[at][by_term], return_index=True)
        out.append((rows, np.repeat(np.arange(len(rows), dtype=np.int32), n), s.term[at], by_term, terms, first.astype(np.int32)))
    return out


def _in_turns(s: _Sample, seed: int, turns: int = 3, steps: int = 60, size: int = 128, rate: float = 0.4, l2: float = 0.03) -> Parameters:
    """Factors of all terms by stochastic gradients with momentum, weights under the L1 penalty between the turns."""
    rng = np.random.default_rng(seed)
    v, pull = rng.normal(0, 0.02, (s.terms, FACTORS)).astype(np.float32), np.zeros((s.terms, FACTORS), np.float32)
    batches, offset = _batches(s, size, rng), np.zeros(s.n)
    for _ in range(turns):
        w, b = _sparse_weights(s, offset, 3, 60)
        base = b + s.linear(w)
        for step in range(steps):
            rows, row, term, by_term, terms, first = batches[step % len(batches)]
            if not len(term):
                continue
            x = v[term]
            head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            total, square = np.zeros((len(rows), FACTORS), np.float32), np.zeros(len(rows), np.float32)
            total[row[head]], square[row[head]] = np.add.reduceat(x, head, axis=0), np.add.reduceat((x * x).sum(1), head)
            d = ((sigmoid(base[rows] + 0.5 * ((total * total).sum(1) - square)) - s.y[rows]) * s.weight[rows] * s.n / len(rows)).astype(np.float32)
            grad = np.add.reduceat((d[row][:, None] * (total[row] - x))[by_term], first, axis=0)
            grad *= min(1.0, 0.5 / max(float(np.sqrt((grad * grad).sum())), 1e-9))
            pull[terms] = 0.8 * pull[terms] + grad
            v[terms] = v[terms] * (1 - rate * l2) - rate * pull[terms]
        offset = s.pairs(v)
    w, b = _sparse_weights(s, offset, 3, 60)
    return b, w, v.astype(float)


def fit(rows: list[tuple[np.ndarray, int]], rate: float, seed: int = 7) -> Machine:
    """rows: (buckets, label); rate: label 1's share among all labelled rows, to which the bias is set back from the balanced sample's."""
    feature = np.full(BUCKETS, -1, np.int32)
    y = np.array([t for _, t in rows], float)
    if not rows or y.min() == y.max():
        return Machine(feature, -40.0 if not rows or not y.max() else 40.0, np.zeros(1), np.zeros((1, 1)))
    held = np.zeros(BUCKETS, bool)
    for b, _ in rows:
        held[b] = True
    bucket = np.flatnonzero(held)
    number = np.zeros(BUCKETS, np.int32)
    number[bucket] = np.arange(len(bucket), dtype=np.int32)
    term = np.concatenate([number[b] for b, _ in rows])
    whole = _Sample(np.repeat(np.arange(len(rows), dtype=np.int32), [len(b) for b, _ in rows]), term, len(bucket), y)

    def selected(s: _Sample) -> tuple[np.ndarray, Parameters]:
        kept = np.flatnonzero(_sparse_weights(s, np.zeros(s.n))[0])
        return kept, _joint(s.only(kept), seed)

    def everything(s: _Sample) -> tuple[np.ndarray, Parameters]:
        return np.arange(s.terms), _in_turns(s, seed)

    place = np.empty(len(y), int)  # of each row among its label's
    for t in (0, 1):
        place[y == t] = np.arange((y == t).sum())
    back = place % 5 == 4
    way = selected
    if len(set(y[back])) == 2:
        learn, check = whole.take(np.flatnonzero(~back)), whole.take(np.flatnonzero(back))
        losses = []
        for candidate in (selected, everything):
            kept, (b, w, v) = candidate(learn)
            seen = check.only(kept)
            losses.append(seen.loss(b + seen.linear(w) + seen.pairs(v)) if len(kept) else check.loss(np.full(check.n, b)))
        way = everything if losses[1] < losses[0] else selected
    kept, (b, w, v) = way(whole)
    some = (w[: len(kept)] != 0) | (np.abs(v[: len(kept)]) > 1e-4).any(1) if len(kept) else np.zeros(0, bool)
    kept = kept[some]
    feature[bucket[kept]] = np.arange(len(kept))
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    none = not len(kept)
    return Machine(feature, b + np.log(rate / (1 - rate)), np.zeros(1) if none else w[some], np.zeros((1, 1)) if none else v[some].astype(np.float32))


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Fit on labelled rows outside the held-out fold; a key with several labels counts as toxic if one says so, of several texts the one whose terms come first counts."""
    named = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_k")).agg(F.max(F.col(label).cast("int")).alias("_y")).where(~held_out("_k"))
    counts = {r["_y"]: r["n"] for r in named.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for y in (0, 1):
        keep = keep | ((F.col("_y") == y) & scratch.share("_k", sample, counts.get(y, 0)))
    chosen = named.where(keep)  # about 2 * sample rows at most, so small enough to broadcast
    rows = docs.select(F.col(key).cast("long").alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t")).join(F.broadcast(chosen), "_k").select("_k", "_t", "_y")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in text_chunks(b.column(1)):
                row, bucket = term_buckets(data, offs)
                parts = np.split(bucket.astype("<i4"), np.searchsorted(row, np.arange(1, hi - lo)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([p.tobytes() for p in parts], pa.binary()), b.column(2).slice(lo, hi - lo)], ["k", "b", "y"])

    each = rows.mapInArrow(hashed, "k long, b binary, y int").groupBy("k", "y").agg(F.min("b").alias("b"))
    got = sorted((r["y"], bytes(r["b"])) for r in each.toLocalIterator())
    return fit([(np.frombuffer(b, "<i4"), y) for y, b in got], counts.get(1, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts score what the bias alone gives.  Repeated rows score
    alike; a null id is never held out.  Without labels of both classes all
    scores are those of the one class (0 where there is none).
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in text_chunks(b.column(2)):
                s = model.value.scores(data, offs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score threshold or more; columns as they were.

    Null and empty texts score what the bias alone gives, repeated rows alike;
    very long texts are scored whole; an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in text_chunks(b.column(at)):
                yield b.slice(lo, hi - lo).filter(pa.array(model.value.scores(data, offs) < threshold))

    return docs.mapInArrow(run, docs.schema)
