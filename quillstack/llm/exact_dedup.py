"""Exact dedup against a minimal perfect hash of the digests seen before.

The history's distinct digests are dealt to buckets of a few thousand.  A
bucket's perfect hash gives each digest a slot that holds the full digest, the
winner's locator and the count.  The incoming distinct digests look themselves
up: a slot whose digest is equal byte for byte makes them repeats of its
winner, all others are grouped among themselves.  Copies are counted before
any shuffle (partial aggregation), so a text that makes up a third of the rows
is one row per task by then; the decisions return to the rows by a join on the
digest that adaptive execution splits where it is skewed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mph, scratch

SPACES = r"[\x20\x09-\x0D]+"
BUCKET = 2048
INDEX = "bucket long, mph binary, digests binary, winners binary, counts binary"
DECIDED = "digest binary, keep_null long, keep_id long, keep_row long, group_size long"
_LOCATOR = np.dtype([("null", "<i8"), ("id", "<i8"), ("row", "<i8")])


def text_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """row_id, doc_id, digest (SHA-256 of the text with each white-space run as one space; null as empty)."""
    norm = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACES, " ")
    return docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row_id"), F.col(key).cast("long").alias("doc_id"), F.unhex(F.sha2(norm, 256)).alias("digest")
    )


def _distinct(digests: DataFrame, buckets: int) -> DataFrame:
    return (
        digests.groupBy("digest")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("row_id").alias("r"))).alias("w"), F.count("*").alias("count"))
        .select(
            F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket"), "digest", F.col("w.n").cast("long").alias("win_null"),
            F.coalesce("w.i", F.lit(0)).alias("win_id"), F.col("w.r").alias("win_row"), "count",
        )
    )


def _digests(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["digest"].to_pylist()), np.dtype("V32"))


def _hash(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)[:, 1].copy()


def _locators(table: pa.Table) -> np.ndarray:
    out = np.zeros(table.num_rows, _LOCATOR)
    for f, c in (("null", "win_null"), ("id", "win_id"), ("row", "win_row")):
        out[f] = table[c].to_numpy()
    return out


def _build(table: pa.Table) -> pa.Table:
    digests = _digests(table)
    keys = _hash(digests)
    index = mph.build(keys)
    slot = mph.lookup(index, keys)
    order = np.argsort(slot)
    return pa.table(
        {
            "bucket": [table["bucket"][0].as_py()], "mph": [index], "digests": [digests[order].tobytes()],
            "winners": [_locators(table)[order].tobytes()], "counts": [table["count"].to_numpy().astype("<i8")[order].tobytes()],
        }
    )


def build_history(digests: DataFrame, buckets: int) -> DataFrame:
    """The index: one row per bucket with its perfect hash and its slots, as a written table."""
    return scratch.save(_distinct(digests, buckets).groupBy("bucket").applyInArrow(_build, INDEX), "digest-index")


def _decide(index: pa.Table, new: pa.Table) -> pa.Table:
    digests, where, size = _digests(new), _locators(new), new["count"].to_numpy().astype(np.int64)
    member = np.zeros(len(digests), bool)
    parts = []
    if index.num_rows:
        held = np.frombuffer(index["digests"][0].as_py(), "V32")
        winners = np.frombuffer(index["winners"][0].as_py(), _LOCATOR)
        counts = np.frombuffer(index["counts"][0].as_py(), "<i8").copy()
        if len(digests):
            slot = mph.lookup(index["mph"][0].as_py(), _hash(digests))
            a = np.ascontiguousarray(held[np.maximum(slot, 0)]).view(np.uint64).reshape(-1, 4)
            member = (slot >= 0) & (a == np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)).all(1)
            np.add.at(counts, slot[member], size[member])
        parts.append((held, winners, counts))
    parts.append((digests[~member], where[~member], size[~member]))
    d, w, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.table(
        {"digest": pa.array([x.tobytes() for x in d], pa.binary()), "keep_null": w["null"], "keep_id": w["id"], "keep_row": w["row"], "group_size": c}
    )


def decide(new: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """One row per distinct digest of history and new rows: the row that stays and the number of rows."""
    return index.groupBy("bucket").cogroup(_distinct(new, buckets).groupBy("bucket")).applyInArrow(_decide, DECIDED)


def _decisions(docs: DataFrame, key: str, text: str, row: str | None, history_below: int | None) -> DataFrame:
    digests = scratch.save(text_digests(docs, key, text, row), "digests")
    lo, hi, rows = digests.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    pivot = history_below if history_below is not None else (None if lo is None else (lo + hi) // 2 + 1)
    buckets = max(64, -(-rows // BUCKET))
    old = F.coalesce(F.col("doc_id") < F.lit(pivot).cast("long"), F.lit(False))
    index = build_history(digests.where(old), buckets)
    decided = decide(digests.where(~old), index, buckets)
    return digests.join(decided, "digest").withColumn("kept", F.col("row_id") == F.col("keep_row"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", history_below: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest doc_id stays; null ids come last
    and of rows with the same id the first read stays.  Rows with ids under
    ``history_below`` (default: the middle of the id range) form the history,
    so its winners precede every incoming row.  Null and empty texts are equal.
    An empty table gives an empty result; other columns are not looked at.
    """
    return _decisions(docs, key, text, None, history_below).select(
        "doc_id",
        F.when(F.col("keep_null") == 0, F.col("keep_id")).alias("keep_id"),
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; columns as they were.

    Of rows with the same id and text, and of those with null ids, the first
    read stays.  Null and empty texts are equal to each other, blank ones (one
    space each) too.  An empty table stays empty.
    """
    rid = scratch.fresh(docs, "_rid")
    rows, _ = scratch.with_row_key(docs, key, rid)
    gone = _decisions(rows, key, text, rid, None).where(~F.col("kept")).select(F.col("row_id").alias(rid))
    return rows.join(gone, rid, "left_anti").select(*docs.columns)
