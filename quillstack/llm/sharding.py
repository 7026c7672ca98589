"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split.

A row's address is 60 bits of its key's hash followed by 60 bits of its row
number's.  Byte counts per prefix of a first depth are rolled up bit by bit; a
row's shard is its shortest prefix whose rows fit the limit.  Prefixes that do
not fit at that depth go on alone with ``STEP`` more bits, until every shard
fits or is one document, which is never cut.  Rows that share a key part by the
second half of the address, so a key with a third of all rows is split too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

BITS = 60
STEP = 6


def _bits(value: Column) -> Column:
    return F.lpad(F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, BITS // 4), 16, 2), BITS, "0")


def addresses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rid, doc_id, bytes (of the text; null: 0), bits."""
    rows, _ = scratch.with_row_key(docs.select(F.col(key).cast("long").alias("doc_id"), F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long").alias("bytes")))
    return rows.select(F.col("_rid").alias("rid"), "doc_id", "bytes", F.concat(_bits(F.col("doc_id")), _bits(F.col("_rid"))).alias("bits"))


def assign(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, directory).

    rows: rid, doc_id, bytes, shard of every row.  directory: shard (its prefix
    bits, '' while one shard holds everything), depth, shard_bytes, shard_docs.
    Shards hold at most limit bytes unless they are one longer document.  Null
    texts have no bytes; null keys share a hash and part by row.  An empty
    table gives an empty directory.
    """
    rows = scratch.save(addresses(docs, key, text), "addresses")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth, low = max(0, (total // limit).bit_length() + 2), 0
    left, found, placed = rows, [], []
    while True:
        cells = left.groupBy(F.substring(F.col("bits"), 1, depth).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
        spread = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(depth))))
        sums = spread.groupBy("depth", F.expr("substring(p, 1, depth)").alias("q")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        fits = sums.where((F.col("b") <= limit) | (F.col("n") == 1) | (F.col("depth") == 2 * BITS))
        # a prefix is a shard if it fits and the one a bit shorter doesn't
        outer = fits.select((F.col("depth") + 1).alias("depth"), "q")
        kin = fits.withColumn("up", F.expr("substring(q, 1, depth - 1)")).alias("c")
        parent = outer.alias("o")
        shards = kin.join(parent, (F.col("c.depth") == F.col("o.depth")) & (F.col("c.up") == F.col("o.q")), "left_anti").select(F.col("c.q").alias("shard"), F.col("c.depth").alias("depth"), F.col("c.b").alias("shard_bytes"), F.col("c.n").alias("shard_docs"))
        found.append(scratch.save(shards, "directory"))
        # A row's shard by its cell: the cells, far fewer than the rows, are matched with the directory at every depth.
        kept = cells.select("p", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("depth")).withColumn("shard", F.expr("substring(p, 1, depth)")).join(found[-1].select("shard", "depth"), ["shard", "depth"])
        kept = scratch.save(kept.select("p", "shard"), "cells")
        placed.append(left.withColumn("p", F.substring(F.col("bits"), 1, depth)).join(kept, "p").select("rid", "doc_id", "bytes", "shard"))
        over = sums.where((F.col("depth") == depth) & (F.col("b") > limit) & (F.col("n") > 1))
        if depth >= 2 * BITS or over.limit(1).count() == 0:
            break
        left = scratch.save(left.join(over.select(F.col("q").alias("p")), F.substring(F.col("bits"), 1, depth) == F.col("p"), "left_semi"), "oversized")
        low, depth = depth + 1, min(2 * BITS, depth + STEP)
    directory = found[0]
    for more in found[1:]:
        directory = directory.unionByName(more)
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out, directory


def sharded(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, doc_bytes, shard, depth, shard_bytes, shard_docs of every row; nulls, repeats and empty tables as in assign."""
    rows, directory = assign(docs, limit, key, text)
    return rows.join(directory, "shard").select("doc_id", F.col("bytes").alias("doc_bytes"), "shard", "depth", "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, limit: int, path: str, key: str = "doc_id", text: str = "text", folder: str = "shard") -> None:
    """One folder ``folder=bits`` per shard with its rows, columns as they were; docs must not have a column named like the folder."""
    if folder.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"{folder!r} is a column of the table: name another folder")
    rid = scratch.fresh(docs, "_rid")
    numbered, _ = scratch.with_row_key(docs, key, rid)
    rows, _ = assign(numbered, limit, rid, text)
    numbered.join(rows.select(F.col("doc_id").alias(rid), F.col("shard").alias(folder)), rid).drop(rid).repartition(folder).write.partitionBy(folder).parquet(path)
