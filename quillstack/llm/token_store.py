"""Token shards on disk, with a perfect-hash index from document keys to offsets.

Payload: rows of raw ids, 2 or 4 bytes each, in ascending key order; a row
holds the whole documents of one run of keys (about ``BLOCK`` ids, or one
longer document).  Index: keys are dealt to buckets of a few thousand; a
bucket's minimal perfect hash gives a slot with the key's 64-bit fingerprint
and its locators (part, block, offset, length).  A key is found by one hash, one
compare and one slice, however large the store is.  Both are written as Parquet
rows of binary columns, so commits are atomic on any store that Spark writes.
The index lies in order of its buckets and the payload in order of its parts and
blocks; up to ``FEW`` asked keys read only the row groups and pages that can hold
theirs, and more keys are joined with the whole index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mph, scratch
from .packing import part_offsets
from .textscan import U, mix, text_chunks
from .word_tokens import encoder

BLOCK = 1 << 18
KEYS = 4096
#: So many asked keys (or blocks that hold them) at most are named in the filters of a scan.
FEW = 256
PAYLOAD = "part int, block int, local_start long, keys array<long>, ends array<long>, width int, payload binary"
INDEX = "bucket long, mph binary, fingerprints binary, first binary, locators binary"
FOUND = "key long, part int, block int, offset long, n_tokens long"
NULL_KEY = 0x7D1F3C59A2B4E687
_LOC = np.dtype([("part", "<i4"), ("block", "<i4"), ("offset", "<i8"), ("n", "<i8")])


@dataclass
class TokenStore:
    payload: str
    index: str
    buckets: int


def _blocks(tokenizer: str, end_id: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, added), TaskContext.get().partitionId()
        dtype = "<u2" if max(enc.size, end_id + 1) <= 1 << 16 else "<u4"
        block = before = 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate([x[1] for x in held])
            n = np.concatenate([x[2] for x in held])
            keys = pa.concat_arrays([x[0] for x in held])
            one = lambda v, t: pa.array([v], t)
            return pa.RecordBatch.from_arrays(
                [one(part, pa.int32()), one(block, pa.int32()), one(before, pa.int64()), one(keys.to_pylist(), pa.list_(pa.int64())), one(np.cumsum(n), pa.list_(pa.int64())), one(ids.itemsize, pa.int32()), one(ids.tobytes(), pa.binary())],
                ["part", "block", "local_start", "keys", "ends", "width", "payload"],
            )

        for b in batches:
            for lo, hi, data, offs in text_chunks(b.column(1), 1 << 20):
                ids, ends = enc.encode(data, offs)
                ids = np.insert(ids, ends, end_id).astype(dtype)
                n = np.diff(ends + np.arange(1, len(ends) + 1), prepend=0)
                held.append((b.column(0).slice(lo, hi - lo), ids, n))
                size += ids.size
                if size >= BLOCK:
                    yield row()
                    block, before, size, held = block + 1, before + size, 0, []
        if held:
            yield row()

    return run


def _key_hash(keys: np.ndarray, null: np.ndarray) -> np.ndarray:
    return np.where(null, U(NULL_KEY), mix(keys.astype(np.int64).view(np.uint64) ^ U(0x5851F42D4C957F2D)))


def _column(c: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    null = np.asarray(c.is_null())
    return c.fill_null(0).to_numpy(), null


def _build(t: pa.Table) -> pa.Table:
    hashed = _key_hash(*_column(t["key"]))
    loc = np.zeros(t.num_rows, _LOC)
    for f, c in (("part", "part"), ("block", "block"), ("offset", "offset"), ("n", "n_tokens")):
        loc[f] = t[c].to_numpy()
    distinct = np.unique(hashed)
    index = mph.build(distinct)
    slot = mph.lookup(index, hashed)
    order = np.lexsort((loc["offset"], loc["block"], loc["part"], slot))
    prints = np.zeros(distinct.size, np.uint64)
    prints[slot] = hashed
    first = np.searchsorted(slot[order], np.arange(distinct.size + 1))
    return pa.table({"bucket": [t["bucket"][0].as_py()], "mph": [index], "fingerprints": [prints.tobytes()], "first": [first.astype("<i8").tobytes()], "locators": [loc[order].tobytes()]})


def _find(index: pa.Table, keys: pa.Table) -> pa.Table:
    out = {f: [] for f in ("key", "part", "block", "offset", "n_tokens")}
    if not index.num_rows or not keys.num_rows:
        return pa.table({k: pa.array([], pa.int32() if k in ("part", "block") else pa.int64()) for k in out})
    value, null = _column(keys["key"])
    hashed = _key_hash(value, null)
    prints = np.frombuffer(index["fingerprints"][0].as_py(), np.uint64)
    first = np.frombuffer(index["first"][0].as_py(), "<i8")
    loc = np.frombuffer(index["locators"][0].as_py(), _LOC)
    slot = mph.lookup(index["mph"][0].as_py(), hashed)
    hit = np.flatnonzero((slot >= 0) & (prints[np.maximum(slot, 0)] == hashed))
    n = first[slot[hit] + 1] - first[slot[hit]]
    row = np.repeat(hit, n)
    at = np.repeat(first[slot[hit]] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return pa.table({"key": pa.array(value[row], mask=null[row]), "part": loc["part"][at], "block": loc["block"][at], "offset": loc["offset"][at], "n_tokens": loc["n"][at]})


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", added: bool = False) -> TokenStore:
    """Write all documents' ids, each with end_id after it, in ascending key order.

    Null texts are the end id alone; null keys come first and share one entry,
    as do repeated keys, which stand next to each other in the order of a hash
    of their texts.  An empty table gives a store without rows.  added: as in packing.pack.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, "key", "_h").sortWithinPartitions("key", "_h").select("key", "text")
    path = scratch.new_path(spark, "token-payload")
    placed.mapInArrow(_blocks(tokenizer, end_id, added), PAYLOAD).write.option("compression", "zstd").parquet(path)
    scratch.free_shuffles(spark)
    heads = spark.read.schema(PAYLOAD).parquet(path).select("part", "block", "keys", "ends")
    n_docs = heads.agg(F.sum(F.size("keys"))).first()[0] or 0
    buckets = max(64, -(-n_docs // KEYS))
    each = heads.select("part", "block", "ends", F.posexplode("keys").alias("i", "key"))
    offset = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.try_element_at("ends", F.col("i")))
    each = each.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "part", "block", offset.cast("long").alias("offset"), (F.try_element_at("ends", F.col("i") + 1) - offset).alias("n_tokens"))
    index = scratch.new_path(spark, "token-index")
    each.repartitionByRange(parts, "bucket").groupBy("bucket").applyInArrow(_build, INDEX).write.parquet(index)
    return TokenStore(path, index, buckets)


def _bucket(key: str, store: TokenStore) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(store.buckets))


def _few(rows: DataFrame) -> list | None:
    """The rows, if they are ``FEW`` at most."""
    got = rows.limit(FEW + 1).collect()
    return got if len(got) <= FEW else None


def locate(spark: SparkSession, store: TokenStore, keys: DataFrame, key: str = "key") -> DataFrame:
    """key, part, block, offset, n_tokens of every document stored under each distinct key; unknown keys give no row.

    Up to ``FEW`` rows of keys read only their buckets of the index.
    """
    asked = keys.select(F.col(key).cast("long").alias("key")).distinct().withColumn("bucket", _bucket("key", store))
    index = spark.read.schema(INDEX).parquet(store.index)
    few = _few(keys.select(_bucket(key, store).alias("bucket")))
    if few is not None:
        index = index.where(F.col("bucket").isin(sorted({r["bucket"] for r in few})))
    return index.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_find, FOUND)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            ids = np.frombuffer(r["payload"], "<u2" if r["width"] == 2 else "<u4").astype("<u4")
            ends = np.array(r["ends"], np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            crc = [zlib.crc32(ids[a:z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, r["part"], np.int32)), pa.array(np.full(n, r["block"], np.int32)), pa.array(starts), pa.array(starts + r["local_start"]), pa.array(ends - starts), pa.array(crc, pa.int64())],
                ["part", "block", "offset", "in_part", "length", "ids_crc32"],
            )


def read_digests(spark: SparkSession, store: TokenStore) -> DataFrame:
    """part, block, offset, start (over the whole store), length, ids_crc32 of each stored document, from the payload rows."""
    payload = spark.read.schema(PAYLOAD).parquet(store.payload)
    starts = part_offsets(payload.select("part", (F.try_element_at("ends", F.lit(-1))).alias("n_tokens")))
    rows = payload.select("part", "block", "local_start", "ends", "width", "payload").mapInArrow(_read, "part int, block int, offset long, in_part long, length long, ids_crc32 long")
    return rows.join(starts, "part").select("part", "block", "offset", (F.col("part_start") + F.col("in_part")).alias("start"), "length", "ids_crc32")


def fetch(spark: SparkSession, store: TokenStore, keys: DataFrame, key: str = "key") -> DataFrame:
    """key, ids (little-endian unsigned 32 bit) of the asked keys' documents; unknown keys give no row, a repeated key one for each document.

    Up to ``FEW`` rows of keys in as many blocks read only these blocks of the payload.
    """
    where = locate(spark, store, keys, key)
    payload = spark.read.schema(PAYLOAD).parquet(store.payload).select("part", "block", "width", "payload")
    few = _few(where.select("part", "block").distinct()) if _few(keys.select(key)) is not None else None
    if few is not None:
        payload = payload.where(F.col("part").isin(sorted({r["part"] for r in few})) & F.col("block").isin(sorted({r["block"] for r in few})))
    cut = where.join(payload, ["part", "block"]).select("key", "width", F.expr("substring(payload, cast(offset * width + 1 as int), cast(n_tokens * width as int))").alias("raw"))

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.frombuffer(x, "<u2" if w == 2 else "<u4").astype("<u4").tobytes() for x, w in zip(b.column("raw").to_pylist(), b.column("width").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(raw, pa.binary())], ["key", "ids"])

    return cut.mapInArrow(widen, "key long, ids binary")
