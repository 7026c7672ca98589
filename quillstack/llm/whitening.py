"""Whitening of embeddings by MLlib's singular value decomposition.

Every entry becomes an integer, so sums are exact and a row's distance from the
mean, times the number of rows, is an exact integer vector.  Those vectors,
divided once, are the rows of a distributed matrix whose right singular vectors
are the eigenvectors of the covariance; an eigenvalue is a squared singular
value over the number of rows.  The total variance does not come from the
decomposition: it is summed from the exact deviations.

Only the covariance (dimensions squared), the eigenvectors and the sums reach
the driver; they don't grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Singular values below this share of the largest are rounding errors of a lower rank: their components are left out.
RANK = 4e-6


def finite(vector: str) -> Column:
    """The vector is there, and so is each of its entries, as a finite number."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))


def integers(vector: str, scale: int, shift: int = 0) -> Column:
    """floor(scale * entry) + shift of every entry; null where the vector isn't usable."""
    return F.when(finite(vector), F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("long") + F.lit(shift)))


def _matrix(rows: DataFrame, column: str) -> RowMatrix:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v"))


def _square_sums(d: np.ndarray) -> pa.Array:
    """Row sums of squares, exact: in 64 bits where they fit, else in Python's integers."""
    most = int(np.abs(d).max(initial=0))
    if most * most * max(d.shape[1], 1) < 1 << 63:
        return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
    return pa.array([sum(x * x for x in row) for row in d.tolist()], pa.decimal128(38, 0))


def entries(column: pa.Array, rows: int, width: int) -> np.ndarray:
    """An Arrow list column, all of whose lists have ``width`` entries, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, width)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal), whitened, explained, identity_error: a row for each usable vector and component.

    Vectors that are null or hold a null or non-finite entry are left out and
    not counted in n.  A vector shorter than the longest counts as 0 in the
    entries that it lacks.  Repeated rows and null keys count and come out as
    often as they are there; other columns are not read.  Components whose
    variance is 0 (constant or dependent dimensions, fewer rows than
    dimensions) are left out, so that equal vectors only, one row or none give
    an empty result.  Eigenvalues that tie take any basis of their space, one
    for all rows.  Entries whose product with ``scale`` leaves 64 bits raise an error.
    """
    spark = vectors.sparkSession
    x = vectors.select(F.col(key).alias("vec_id"), integers(vector, scale, shift).alias("x")).where("x IS NOT NULL")
    schema = f"vec_id {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    n = x.count()
    sums = {r["pos"]: (r["s"], r["c"]) for r in x.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s"), F.count("*").alias("c")).collect()}
    width = len(sums)
    if not width:
        return spark.createDataFrame([], schema)
    total = F.array(*(F.lit(sums[j][0] + shift * (n - sums[j][1])).cast("long") for j in range(width)))
    apart = F.zip_with("x", total, lambda a, s: F.coalesce(a, F.lit(shift)) * F.lit(n).cast("long") - s)
    exact = scratch.save(x.select("vec_id", apart.alias("d")), "apart")
    centred = exact.select(F.transform("d", lambda d: d.cast("double") / F.lit(float(n))).alias("c"))
    svd = _matrix(centred, "c").computeSVD(min(components, width), False, RANK)
    values = svd.s.toArray() ** 2 / n
    if not values[0] > 0:
        return spark.createDataFrame([], schema)
    project = spark.sparkContext.broadcast(svd.V.toArray() / np.sqrt(values))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = entries(b.column(1), b.num_rows, width)
                w = (d.astype(float) / n) @ project.value
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), _square_sums(d), lists], ["vec_id", "deviation", "w"])

    white = scratch.save(exact.mapInArrow(rows, f"vec_id {vectors.schema[key].dataType.simpleString()}, deviation decimal(38,0), w array<double>"), "white")
    seen = white.agg(F.sum("deviation").alias("total"), Summarizer.mean(array_to_vector("w")).alias("mean")).first()
    explained = values / (int(seen["total"]) / n**3)
    mean = F.array(*(F.lit(float(m)) for m in seen["mean"].toArray()))
    gram = _matrix(white.select(F.zip_with("w", mean, lambda a, m: a - m).alias("c")), "c").computeGramianMatrix().toArray()
    error = float(np.abs(gram / n - np.eye(len(values))).max())
    each = white.select("vec_id", "deviation", F.posexplode("w").alias("_p", "whitened"))
    share = F.element_at(F.array(*(F.lit(float(e)) for e in explained)), F.col("_p") + 1)
    return each.select("vec_id", (F.col("_p") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
