"""Hard negatives from k-means inverted lists, searched exactly.

Every row lies in the list of its nearest centroid; a list keeps its radius, the
largest distance of its rows from the centroid c.  By Cauchy and Schwarz no row
of a list scores more than <a, c> + |a| radius against an anchor a, nor less
than <a, c> - |a| radius.  An anchor visits lists in falling order of that
bound: the first few give it a k-th score, and then only lists are visited
whose bound isn't strictly below it and whose bounds meet the window asked for.

A visit is a row: the anchor, dealt to each block of the list.  Blocks hold
about ``BLOCK`` rows at most, however large a list is, and come sorted before
their visitors, so a task holds one block and a batch of anchors, scores them
with one matrix product, and gives the best k of the block for each anchor.

Scores are inner products of integer vectors, exact in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .whitening import integers

#: Rows that the centroids are fitted on at most; every row is in the lists.
SAMPLE = 20000
LISTS = 1024
BLOCK = 2048
#: Lists that an anchor visits before it has a k-th score.
FIRST = 2
#: Anchors scored at once.
TILE = 128
ROW = "block long, kind int, rid long, vec_id long, label long, v binary, lo array<long>, hi array<long>, least array<long>"
FOUND = "rid long, place int, score long, vec_id long"
LOWEST = -(1 << 62)


@dataclass(frozen=True)
class Shape:
    """Of each list its centroid, radius, number of blocks and first block, and the type of a vector's entries: all that tasks need besides the rows."""

    centroids: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray
    first: np.ndarray
    dtype: str

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that each list could hold for each anchor, rounding included."""
        middle = a @ self.centroids.T
        reach = np.sqrt((a * a).sum(1))[:, None] * self.radius[None, :]
        reach += 1e-9 * (np.abs(middle) + reach) + 1e-6
        return middle - reach, middle + reach


@dataclass(frozen=True)
class Lists:
    """The rows with the number of their list (a written table), and the lists' shape."""

    rows: DataFrame
    shape: Shape


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """Vectors from Arrow binaries of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _pack(m: np.ndarray) -> pa.Array:
    raw, size = np.ascontiguousarray(m), m.shape[1] * m.itemsize
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer((np.arange(len(m) + 1) * size).astype("<i4")), pa.py_buffer(raw)])


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", scale: int = 256, lists: int = LISTS) -> Lists | None:
    """Inverted lists of all usable rows; None if there are none."""
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    whole = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), integers(vector, scale).alias("v"))
    whole = whole.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    seen = whole.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("most")).first()
    n, width, most = seen["n"], max(seen["width"] or 0, 1), seen["most"] or 0
    if not n:
        return None
    if most * most * width >= 1 << 50:
        raise ValueError("scores beyond 2^50: scale the vectors down")
    dtype = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    whole = whole.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))
    sample = whole.where(scratch.share("rid", SAMPLE, n)).select(array_to_vector(F.transform("v", lambda c: c.cast("double"))).alias("features"))
    sample = scratch.save(sample, "sample")
    k = int(min(lists, max(1, round(n**0.5 / 8))))
    fitted = KMeans(k=k, maxIter=10, initSteps=2, seed=1).fit(sample).clusterCenters() if k > 1 and not sample.isEmpty() else [np.zeros(width)]
    centroids = np.array(fitted, float).reshape(-1, width)
    shared = spark.sparkContext.broadcast(centroids)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        half = (c * c).sum(1) / 2
        for b in batches:
            m = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            x = m.astype(float)
            at = (x @ c.T - half).argmax(1)
            far = np.sqrt(((x - c[at]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _pack(m.astype(dtype)), pa.array(at.astype(np.int32)), pa.array(far)], ["rid", "vec_id", "label", "v", "list", "far"])

    rows = scratch.save(whole.mapInArrow(nearest, "rid long, vec_id long, label long, v binary, list int, far double"), "lists")
    count, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in rows.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        count[r["list"]], radius[r["list"]] = r["n"], r["far"] * (1 + 1e-9)
    blocks = -(-count // BLOCK)
    return Lists(rows, Shape(centroids, radius, blocks, np.cumsum(blocks) - blocks, dtype))


def _in_blocks(index: Lists) -> DataFrame:
    at = F.col("list") + 1
    first, blocks = (F.element_at(F.array(*(F.lit(int(x)).cast("long") for x in v)), at) for v in (index.shape.first, np.maximum(index.shape.blocks, 1)))
    none = F.lit(None).cast("array<long>")
    return index.rows.select((first + F.pmod(F.xxhash64("rid"), blocks)).alias("block"), F.lit(0).alias("kind"), "rid", "vec_id", "label", "v", none.alias("lo"), none.alias("hi"), none.alias("least"))


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of an Arrow list column and the row of each."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)


def _visits(anchors: DataFrame, shape: Broadcast, later: bool) -> DataFrame:
    """A row for each block that an anchor has to look at: of its first lists, or ``later`` of the others that its k-th scores leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shape.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                low, high = s.bounds(_matrix(part.column("v"), s.dtype).astype(float))
                lo, row = _ragged(part.column("lo"))
                hi, least = _ragged(part.column("hi"))[0], _ragged(part.column("least"))[0]
                meets, still = (np.zeros(high.shape, bool) for _ in range(2))
                for i in range(0, len(row), 4096):
                    r, j = row[i : i + 4096], slice(i, i + 4096)
                    window = (high[r] >= lo[j, None]) & (low[r] <= hi[j, None])
                    np.logical_or.at(meets, r, window)
                    np.logical_or.at(still, r, window & (high[r] >= least[j, None]))
                meets &= s.blocks > 0
                bound = np.where(meets, high, -np.inf)
                order = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]
                head = np.zeros(meets.shape, bool)
                np.put_along_axis(head, order, True, 1)
                who, where = np.nonzero(meets & still & ~head if later else meets & head)
                count = s.blocks[where]
                who = np.repeat(who, count)
                block = np.repeat(s.first[where] - np.cumsum(count) + count, count) + np.arange(count.sum())
                for i in range(0, len(who), 4096):  # a batch of visits is small whatever the number of lists
                    take = part.take(pa.array(who[i : i + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(block[i : i + 4096]), pa.array(np.ones(len(take), np.int32)), *(take.column(c) for c in ("rid", "vec_id", "label", "v", "lo", "hi", "least"))], [x.split()[0] for x in ROW.split(", ")])

    return anchors.select("rid", "vec_id", "label", "v", "lo", "hi", "least").mapInArrow(run, ROW)


def _scored(same: bool, k: int, dtype: str):
    """Streams blocks, each followed by its visitors: the best k rows of every block for each window of each anchor."""

    def best(x: np.ndarray, part: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, rids: np.ndarray) -> pa.RecordBatch:
        a, rid, label = _matrix(part.column("v"), dtype).astype(float), part.column("rid").to_numpy(), part.column("label").to_numpy()
        scores = (a @ x.T).astype(np.int64)
        fits = label[:, None] == labels[None, :]
        fits = fits & (rid[:, None] != rids[None, :]) if same else ~fits
        lo, row = _ragged(part.column("lo"))
        hi, least = _ragged(part.column("hi"))[0], _ragged(part.column("least"))[0]
        n = len(ids)
        out = []
        for i in range(0, len(row), TILE):
            r = row[i : i + TILE]
            j = slice(i, i + TILE)
            s = scores[r]
            ok = fits[r] & (s >= np.maximum(lo[j], least[j])[:, None]) & (s <= hi[j, None])
            rank = np.where(ok, s * n + (n - 1 - np.arange(n)), np.iinfo(np.int64).min)  # rows come by vec_id, so of equal scores the smaller id is the greater rank
            top = np.argpartition(rank, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), rank.shape)
            who, at = np.nonzero(np.take_along_axis(ok, top, 1))
            col = top[who, at]
            out.append((r[who], i + who, s[who, col], ids[col]))
        w, place, score, found = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(4))
        first = np.searchsorted(row, np.arange(len(part)))
        return pa.RecordBatch.from_arrays([pa.array(rid[w]), pa.array((place - first[w]).astype(np.int32)), pa.array(score), pa.array(found)], [x.split()[0] for x in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, x = None, [], None
        for b in batches:
            of, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
            cut = np.concatenate([[0], 1 + np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])), [b.num_rows]])
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if lo == hi:
                    continue
                if of[lo] != block:
                    block, parts, x = of[lo], [], None
                if kind[lo] == 0:
                    parts.append(b.slice(lo, hi - lo).select(["rid", "vec_id", "label", "v"]))
                    continue
                if not parts:
                    continue
                if x is None:
                    x = np.concatenate([_matrix(p.column("v"), dtype) for p in parts]).astype(float)
                    ids, labels, rids = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("vec_id", "label", "rid"))
                for at in range(lo, hi, TILE):
                    yield best(x, b.slice(at, min(TILE, hi - at)), ids, labels, rids)

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("rid", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(anchors: DataFrame, index: Lists, k: int, same: bool) -> DataFrame:
    """rid, place, score, vec_id, rank: of each anchor's windows (arrays lo and hi, inclusive) the best k rows of its label (``same``) or of others."""
    spark = anchors.sparkSession
    shape = spark.sparkContext.broadcast(index.shape)
    rows, scored = _in_blocks(index), _scored(same, k, index.shape.dtype)

    def visit(a: DataFrame, later: bool) -> DataFrame:
        dealt = rows.unionByName(_visits(a, shape, later)).repartition("block").sortWithinPartitions("block", "kind", "vec_id", "rid")
        return scratch.save(_top(dealt.mapInArrow(scored, FOUND), k).drop("rank"), "found")

    open_ended = anchors.withColumn("least", F.transform("lo", lambda _: F.lit(LOWEST)))
    head = visit(open_ended, False)
    kth = head.groupBy("rid", "place").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k)
    known = kth.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("place", "s"))).alias("kth"))  # a window each, few to an anchor
    least = F.transform("lo", lambda _, i: F.coalesce(F.try_element_at("kth", i), F.lit(LOWEST)))
    rest = visit(anchors.join(known, "rid", "left").withColumn("least", least).drop("kth"), True)
    return _top(head.unionByName(rest), k)


def mine(index: Lists | None, spark: SparkSession, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides.  An anchor's positives are
    the first rows of its label, itself excepted; for each, the first rows of
    other labels whose score is ``low`` to ``high`` per cent of the positive's.
    Of equal scores the smaller id comes first.  Repeated rows are rows of their
    own: one may be its twin's positive, and a repeated anchor's result comes
    twice.  Rows with a null id, label or vector, or with a null or non-finite
    entry take no part; shorter vectors are filled up with 0.  A positive with a
    negative score has no negatives.  No rows, no anchors or a single label give
    an empty result.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if index is None:
        return spark.createDataFrame([], schema)
    anchors = index.rows.where(F.col("vec_id") % every == 0).select("rid", F.col("vec_id"), "label", "v")
    whole = anchors.withColumns({"lo": F.array(F.lit(LOWEST)), "hi": F.array(F.lit(-LOWEST))})
    near = search(whole, index, positives, True).select("rid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("place"))
    near = scratch.save(near, "positives")
    p = F.col("positive_score")
    window = F.struct("place", F.expr(f"(positive_score * {low} + 99) div 100").alias("lo"), F.expr(f"(positive_score * {high}) div 100").alias("hi"))
    # Every positive keeps its place; a window of a negative score is empty.
    window = F.when(p >= 0, window).otherwise(F.struct("place", F.lit(1).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi")))
    windows = near.groupBy("rid").agg(F.array_sort(F.collect_list(window)).alias("w"))
    asked = anchors.join(windows, "rid").select("rid", "vec_id", "label", "v", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))
    far = search(asked, index, negatives, False).select("rid", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
    return named.join(far, ["rid", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
