"""Packing: concatenate all documents and cut the stream into fixed windows.

Pass one tokenises each partition and keeps every document's offset inside its
partition.  The partitions' totals, one small row each, become global offsets
by a prefix sum.  Pass two cuts each document where the windows end: pieces
inside one window, and boundary records on both sides of each cut.  Only the
last window of the whole stream is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .textscan import text_chunks
from .word_tokens import encoder

TOKENS = "part int, local_start long, doc_id long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", added: bool = False) -> DataFrame:
    """part, local_start (ids before it in its partition), doc_id, n_tokens with the end id, ids (little-endian, 2 bytes where the vocabulary allows, else 4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(tokenizer, added), TaskContext.get().partitionId(), 0
        dtype = "<u2" if max(enc.size, end_id + 1) <= 1 << 16 else "<u4"
        for b in batches:
            for lo, hi, data, offs in text_chunks(b.column(1)):
                ids, ends = enc.encode(data, offs)
                ids = np.insert(ids, ends, end_id).astype(dtype)
                ends = ends + np.arange(1, len(ends) + 1)
                n = np.diff(ends, prepend=0)
                w = ids.itemsize
                blob = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], ends * w]).astype("<i8")), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(before + ends - n), b.column(0).slice(lo, hi - lo), pa.array(n), blob.cast(pa.binary())],
                    ["part", "local_start", "doc_id", "n_tokens", "ids"],
                )
                before += int(ends[-1])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(run, TOKENS)


def part_offsets(table: DataFrame, n: str = "n_tokens") -> DataFrame:
    """part and part_start: the ids before each partition. One row per partition of the written table."""
    totals = table.groupBy("part").agg(F.sum(n).alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("part_start"))


def with_part_start(table: DataFrame, n: str = "n_tokens", most: int = 1_000_000) -> DataFrame:
    """The offsets are broadcast only while they are known to be few."""
    starts = part_offsets(table, n)
    return table.join(F.broadcast(starts) if table.select("part").distinct().count() <= most else starts, "part")


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = b.column("at").to_numpy(), b.column("n_tokens").to_numpy()
            wide = b.column("wide").to_numpy(zero_copy_only=False)
            ids = b.column("ids")
            first, last = at // width, (at + n - 1) // width
            per = last - first + 1
            row = np.repeat(np.arange(len(n)), per)
            seq = np.repeat(first - np.cumsum(per) + per, per) + np.arange(per.sum())
            lo = np.maximum(seq * width, at[row])
            hi = np.minimum((seq + 1) * width, (at + n)[row])
            out, known = [], -1
            for r, a, z in zip(row.tolist(), (lo - at[row]).tolist(), (hi - at[row]).tolist(), strict=True):
                if r != known:
                    whole, known = np.frombuffer(ids[r].as_py(), "<u4" if wide[r] else "<u2").astype("<u4"), r
                out.append(whole[a:z].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row)), pa.array(lo - at[row]), pa.array(hi - lo), pa.array(out, pa.binary()), pa.array(n[row]), pa.array(seq), pa.array(lo - seq * width)],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, width: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", added: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32 bit), doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone.  A repeated row is packed again;
    a null doc_id is packed and stays null.  Any number of pieces comes from a
    very long text.  An empty table gives no piece; other columns are not read.
    added: a special token's literal in a text is that token, as in the library's
    default; otherwise it is plain text.
    """
    table = scratch.save(tokenise(docs, tokenizer, end_id, key, text, added), "tokens")
    placed = with_part_start(table).select(
        "doc_id", (F.col("part_start") + F.col("local_start")).alias("at"), "n_tokens", (F.length("ids") == 4 * F.col("n_tokens")).alias("wide"), "ids"
    )
    return placed.mapInArrow(_cut(width), PIECES)


def sequences(pieces: DataFrame, width: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids (width ids, padded): each window's pieces put together, at most width of them."""
    joined = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    body = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (F.lit(width) - F.col("n_tokens")).cast("int")))
    return joined.select("sequence_id", "n_tokens", F.concat(body, pad).alias("ids"))
