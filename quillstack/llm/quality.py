"""Quality verdicts by gradient-boosted trees over document statistics.

Exact statistics of every whole text come from vectorised byte scans and are
written once, a row of numbers per document.  The trees are fitted on at most
``SAMPLE`` labelled rows of that table, with the sign of some features' effect
held (more symbols never raise a verdict), and flattened into numpy node arrays
that score all rows of a batch one tree level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textscan import U, lookup, mix, shingles, span_hash, text_chunks, word_spans

#: Labelled rows that the fit sees at most.
SAMPLE = 20000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "n_chars")
#: Features and the sign that their effect on the verdict must have (0: free).
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "digits": 0, "marks": 0, "distinct": 1, "line_words": 0}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[x for x in b"#*$%&|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[[x for x in b"!?;:=_~^@"]] = True


def _per_row(flag: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(flag), offs))


def _repeated(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (row, key) pairs in order of place: which are not their pair's first, and which have a pair at all."""
    k = mix(key + row.astype(np.uint64) * U(0xA24BAED4963EE407))
    order = np.argsort(k, kind="stable")
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[order][1:] == k[order][:-1]
    later, paired = np.zeros(len(k), bool), np.zeros(len(k), bool)
    later[order], paired[order] = same[:-1], same[:-1] | same[1:]
    return later, paired


def statistics(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(offs) - 1
    start, end, row = word_spans(data, offs)
    inner = np.flatnonzero((data & 0xC0) == 0x80)  # bytes that don't begin a character
    chars = end - start - np.searchsorted(inner, end) + np.searchsorted(inner, start)
    out = {"n_words": np.bincount(row, minlength=rows), "word_chars": np.bincount(row, chars, rows).astype(np.int64)}
    out["n_chars"] = np.diff(offs) - np.diff(np.searchsorted(inner, offs))
    out["n_symbols"] = _per_row(lookup(_SYMBOL, data), offs)
    breaks = np.flatnonzero(data == 10)
    first = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    line_row = np.repeat(np.arange(rows), _per_row(data == 10, offs) + 1)
    last = np.append(first[1:], 0)
    final = np.append(line_row[1:] != line_row[:-1], True)
    last = np.where(final, offs[line_row + 1], last - 1)
    words_in = np.searchsorted(start, last) - np.searchsorted(start, first)
    some = words_in > 0
    later, _ = _repeated(line_row[some], span_hash(data, first[some], last[some]))
    out["n_dup_lines"] = np.bincount(line_row[some], later, rows).astype(np.int64)
    word = span_hash(data, start, end)
    covered = np.zeros(len(word), bool)
    if len(word) >= 3:
        window = np.flatnonzero(row[2:] == row[:-2])
        sh, sr = shingles(word, row, rows, 3, short=False)
        at = window[_repeated(sr, sh)[1]]
        for j in range(3):
            covered[at + j] = True
    out["n_repeat_words"] = np.bincount(row, covered, rows).astype(np.int64)
    later, _ = _repeated(row, word)
    out["n_distinct"] = out["n_words"] - np.bincount(row, later, rows).astype(np.int64)
    out["n_lines"] = np.bincount(line_row, some, rows).astype(np.int64)
    out["n_upper"] = _per_row((data >= 65) & (data <= 90), offs)
    out["n_digits"] = _per_row((data >= 48) & (data <= 57), offs)
    out["n_marks"] = _per_row(lookup(_MARK, data), offs)
    return out


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in text_chunks(b.column(1)):
                s = statistics(data, offs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(s[c].astype(np.int64)) for c in COUNTS)], ["doc_id", *COUNTS])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words,
            c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / words, c["n_distinct"] / np.sqrt(words), c["n_words"] / np.maximum(c["n_lines"], 1),
        ],
        1,
    )


class Trees:
    """Flat node arrays: feature (-1: leaf), threshold, left child (right: the next), value."""

    def __init__(self, base: float):
        self.base = base
        self.feature, self.threshold, self.left, self.value, self.roots = [], [], [], [], []
        self.depth = 0

    def freeze(self) -> Trees:
        for name, kind in (("feature", np.int32), ("threshold", float), ("left", np.int32), ("value", float), ("roots", np.int32)):
            setattr(self, name, np.array(getattr(self, name), kind))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > self.threshold[node]
                node = np.where(inner, self.left[node] + right, node)
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...] = tuple(FEATURES.values()), rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss over feature histograms.

    A split on a feature with a sign must order its children's values so, and
    the middle between them bounds all values below either child.
    """
    if not len(y) or y.min() == y.max():
        return Trees(40.0 if not len(y) or y.max() else -40.0).freeze()
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    p = y.mean()
    model = Trees(float(np.log(p / (1 - p))))
    model.depth = depth
    score = np.full(len(y), model.base)

    def node() -> int:
        for a, v in ((model.feature, -1), (model.threshold, 0.0), (model.left, -1), (model.value, 0.0)):
            a.append(v)
        return len(model.feature) - 1

    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-score))
        g, h = y - prob, prob * (1 - prob)
        root = node()
        model.roots.append(root)
        work = [(root, np.arange(len(y)), 0, -np.inf, np.inf)]
        while work:
            at, rows, level, low, high = work.pop()
            G, H = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if level < depth and H > 2 * least:
                for f, sign in enumerate(signs):
                    size = len(edges[f]) + 1
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], size))[:-1]
                    if not gl.size:
                        continue
                    vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip((G - gl) / (H - hl + ridge), low, high)
                    gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
                    gain[(hl < least) | (H - hl < least) | (sign * (vr - vl) < 0)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k, sign, (vl[k] + vr[k]) / 2))
            if best[1] is None:
                value = float(np.clip(G / (H + ridge), low, high)) * rate
                model.value[at] = value
                score[rows] += value
                continue
            f, k, sign, middle = best[1]
            right = binned[rows, f] > k
            model.feature[at], model.threshold[at] = f, float(edges[f][k])
            left = node()
            node()
            model.left[at] = left
            for child, part, side in ((left, rows[~right], -1), (left + 1, rows[right], 1)):
                bound = sign * side
                work.append((child, part, level + 1, max(low, middle) if bound > 0 else low, min(high, middle) if bound < 0 else high))
    return model.freeze()


def train(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fit on at most about ``sample`` labelled keys, chosen by a hash; of rows that share a key the least statistics count, of its labels the least."""
    named = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("_y"))
    chosen = named.where(scratch.share("doc_id", sample, named.count()))
    each = stats.join(chosen, "doc_id").groupBy("doc_id", "_y").agg(F.min(F.struct(*COUNTS)).alias("s"))
    rows = each.select("doc_id", "_y", "s.*").toPandas().sort_values("doc_id")
    return fit(features({c: rows[c].to_numpy(float) for c in COUNTS}), rows["_y"].to_numpy(float))


def verdicts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, the five statistics, base_failed, quality (the trees' probability), kept.

    Null texts have no words.  Repeated rows get equal verdicts, null ids too.
    Without labels of both classes the trees keep everything (or, if all labels
    are 0, nothing).  Very long texts are counted whole; an empty table gives an
    empty result.
    """
    stats = scratch.save(document_statistics(docs, key, text), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(train(stats, labels, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n).to_numpy() for n in COUNTS}
            q = model.value.probability(features(c))
            failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            cols = [b.column("doc_id"), *(b.column(n) for n in COUNTS[:5]), pa.array(failed), pa.array(q), pa.array(~failed & (q >= threshold))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *COUNTS[:5], "base_failed", "quality", "kept"])

    return stats.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in COUNTS[:5]) + ", base_failed boolean, quality double, kept boolean")
