"""Working tables in the folder that the whole cluster shares.

``spark.checkpoint.dir`` names that folder; where it is unset, a local master
(tests, a laptop) uses a folder under the temp directory, and a cluster is
refused, because its executors may not share one.  A working table
is written once, so a lost executor costs a re-read and never a recompute of
the lineage above it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = f"file://{tempfile.gettempdir()}/quillstack-{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/quillstack/{tag}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def save(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder, let go of the shuffle files behind it, and read it back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    free_shuffles(spark)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes a finished job's shuffle files when its driver-side handles are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        if path in _paths:
            _paths.remove(path)


def release(spark: SparkSession) -> None:
    """Delete every working table. Call it when the results built on them have been written."""
    drop(spark, *list(_paths))


def fresh(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(docs: DataFrame, key: str = "doc_id", name: str = "_rid") -> tuple[DataFrame, str | None]:
    """docs with a unique long column ``name``, which docs must not have (``fresh`` finds one).

    The key itself where it is unique and never null; otherwise (repeated rows,
    null keys) a numbered copy is written once, because row numbers made on the
    fly differ when a lost executor changes how the files are split.
    """
    bad = docs.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(1).count()
    if not bad:
        return docs.withColumn(name, F.col(key).cast("long")), None
    out = save(docs.withColumn(name, F.monotonically_increasing_id()), "rowkeys")
    return out, out._scratch_path


def share(key: str, most: int, total: int) -> Column:
    """Keeps rows by a hash of their distinct key so that, of total rows, at most about ``most`` stay: nothing is sorted or counted for it."""
    fraction = 1.0 if total <= most else max(0.0, (most - 7 * most**0.5) / total)
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)) < F.lit(int(fraction * (1 << 40)))


def token() -> str:
    return uuid.uuid4().hex


def paths() -> list[str]:
    """Of the working tables that are there."""
    return list(_paths)
