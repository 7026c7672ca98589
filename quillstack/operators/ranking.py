"""Row numbers over a whole table without one task for all rows."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the whole cluster shares: ``spark.checkpoint.dir``; a local master without it takes one under the temp folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = f"file://{tempfile.gettempdir()}/quillstack-{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read back; the shuffle files and broadcast tables behind it are let go.

    Columns of keys and names are many times larger in memory than in the files
    by whose size Spark judges what to broadcast, so joins with the table are
    by shuffles.  Say ``broadcast`` where a table is known to be small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstack/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


#: Bytes of text whose words one task sorts: some hundred megabytes of rows, which fit its memory.
RUN_BYTES = 16 << 20


def dealt(df: DataFrame, text: str, *keys: str, most: int = RUN_BYTES) -> DataFrame:
    """df in partitions of about ``most`` bytes of its texts, which move once, before they become rows many times their size."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.repartition(max(size // most + 1, df.sparkSession.sparkContext.defaultParallelism), *keys)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes a finished job's shuffle files and broadcast tables when its driver-side handles are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """df with the rows' numbers from 1 in ``order``, a total order of ascending or descending columns.

    Rows are dealt out by ranges of the order and numbered inside each range; the
    ranges' row counts, one small row each, give the numbers before each range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    table = written(sorted_.withColumn("_at", F.monotonically_increasing_id()), "ranges")  # the range in the upper bits, the row in the lower 33
    rows = table.withColumns({"_range": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_row") + 1).select(*df.columns, name)


def running(df: DataFrame, order: list[Column | str], value: str, name: str = "before", within: list[str] | None = None) -> DataFrame:
    """df with the sum of ``value`` over the rows before each in ``order``, a total order.

    As in ``numbered``: sums inside each range, and one row a range for the sums before it.  Keep df to keys and
    the value: it is written once and shuffled twice.  ``within``: the order's first columns, not null, at whose change
    sums begin anew; only the group that a range begins in can have rows before the range.
    """
    within = within or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    table = written(sorted_.withColumn("_at", F.monotonically_increasing_id()), "sums")
    rows = table.withColumn("_range", F.shiftright("_at", 33))
    inside = Window.partitionBy("_range", *within).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_range", *within).agg(F.sum(value).alias("_n")).select("_range", *within, F.sum("_n").over(before).alias("_before")).where("_before is not null")
    held = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    sums = held.join(F.broadcast(starts), ["_range", *within], "left")
    return sums.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_inside")).select(*df.columns, name)
