import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstack.llm import exact_dedup, mph, packing, sharding, token_store
from quillstack.llm.textscan import text_chunks
from quillstack.llm.word_tokens import Encoder

from .conftest import ROWS

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_word_by_word_ids_are_the_library_ids(library):
    texts = ["", "a  b", " lead", "trail ", "x\ny\n\nz", "tab\tb c", "don't it's 's", "a.b,'s x!'re |'ll [a]'b", " .", "é à　 b c", "a\x1cb", "1 2 3!! ..", "\r\n x", "naïve-test a—b 中文 字"] + [t or "" for _, t, _ in ROWS]
    enc, got = Encoder(PATH), []
    for _ in range(2):  # the second time from the table of known pieces
        got = []
        for _, _, data, offs in text_chunks(pa.array(texts), 64):
            ids, ends = enc.encode(data, offs)
            got += [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [library(t) for t in texts]


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    index = mph.build(keys)
    assert sorted(mph.lookup(index, keys)) == list(range(len(keys)))
    assert len(mph.lookup(index, keys + np.uint64(1))) == len(keys)
    assert mph.lookup(mph.build(keys[:0]), keys[:3]).tolist() == [-1, -1, -1]


def test_exact_dedup(docs):
    rows = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, _ in ROWS]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = list((str(i), min((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    want.sort(key=str)
    for below in (None, 0, 4, 100):
        got = exact_dedup.exact_dedup(docs, history_below=below).collect()
        assert sorted(((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
        kept = [r for r in got if r.kept]
        assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_keep_first_keeps_columns(docs, empty):
    out = exact_dedup.keep_first(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 3, 4, 6, 7, 8, 10]
    assert exact_dedup.exact_dedup(empty).count() == exact_dedup.keep_first(empty).count() == 0


def test_pack_round_trip(docs, empty, library):
    width = 256
    pieces = packing.pack(docs, PATH, width=width, end_id=1)
    rows = pieces.orderBy("sequence_id", "offset").collect()
    parts, fill = defaultdict(int), defaultdict(int)
    texts = defaultdict(list)
    for i, t, _ in ROWS:
        texts[i].append(library(t) + [1])
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length and r.offset == fill[r.sequence_id]
        assert any(r.doc_tokens == len(x) and x[r.start : r.start + r.length] == ids for x in texts[r.doc_id])
        fill[r.sequence_id] += r.length
        parts[r.doc_id] += r.length
    assert parts == {i: sum(map(len, x)) for i, x in texts.items()}
    assert sorted(fill) == list(range(len(fill))) and all(n == width for q, n in fill.items() if q < len(fill) - 1)
    padded = packing.sequences(pieces, width, pad_id=7).orderBy("sequence_id").collect()
    assert all(len(r.ids) == 4 * width for r in padded)
    assert np.frombuffer(bytes(padded[-1].ids), "<u4")[fill[len(fill) - 1] :].tolist() == [7] * (width - fill[len(fill) - 1])
    assert packing.pack(empty, PATH).count() == 0


def test_token_store_round_trip(spark, docs, empty, library):
    store = token_store.write(docs, PATH, end_id=2)
    found = token_store.locate(spark, store, docs, "doc_id").join(token_store.read_digests(spark, store), ["part", "block", "offset"]).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((str(r.key), r.ids_crc32, r.n_tokens) for r in found) == sorted((str(i), crc(library(t) + [2]), len(library(t)) + 1) for i, t, _ in ROWS)
    rows = sorted(found, key=lambda r: r.start)
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    keys = [-1 if r.key is None else r.key for r in rows]
    assert keys == sorted(keys)
    asked = spark.createDataFrame([(3,), (8,), (12345,), (None,)], "key long")
    got = defaultdict(list)
    for r in token_store.fetch(spark, store, asked).collect():
        got[r.key].append(np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert got[3] == [library(ROWS[2][1]) + [2]] and got[8] == [library(ROWS[8][1]) + [2]] and len(got[None]) == 2 and 12345 not in got
    assert token_store.locate(spark, token_store.write(empty, PATH), docs, "doc_id").count() == 0


def _read_rows(df, column):
    """Rows that the scan of the table with the named column gives, after row groups and pages have been left out."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if hasattr(p, "getClass") and "QueryStageExec" in p.getClass().getSimpleName():
            return walk(p.plan())
        if p.getClass().getSimpleName() == "FileSourceScanExec" and column in p.output().toString():
            out.append(p.metrics().apply("numOutputRows").value())
        kids = p.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(plan)
    return sum(out)


def test_few_keys_read_few_buckets_and_blocks(spark, library, monkeypatch):
    monkeypatch.setattr(token_store, "KEYS", 8)
    monkeypatch.setattr(token_store, "BLOCK", 64)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of number "), "id").alias("text"))
    store = token_store.write(docs, PATH)
    asked = spark.createDataFrame([(17,), (3999,), (4000,)], "key long")
    got = {r.key: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in token_store.fetch(spark, store, asked).collect()}
    assert got == {i: library(f"text of number {i}") + [2] for i in (17, 3999)}
    assert _read_rows(token_store.locate(spark, store, asked), "fingerprints") < 300  # of 500 buckets
    assert spark.read.parquet(store.payload).count() > 2
    assert _read_rows(token_store.fetch(spark, store, asked), "payload") == 2  # the blocks of the two keys that are there
    assert token_store.locate(spark, store, docs, "doc_id").count() == 4000


@pytest.mark.parametrize("limit", [40, 200, 10**6])
def test_shards_fit(docs, limit):
    rows = sharding.sharded(docs, limit).collect()
    assert len(rows) == len(ROWS)
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    for s, members in shards.items():
        assert sum(r.doc_bytes for r in members) == members[0].shard_bytes and len(members) == members[0].shard_docs
        assert members[0].shard_bytes <= limit or len(members) == 1
        assert not any(s != o and o.startswith(s) for o in shards)


def test_shards_of_a_repeated_key(spark):
    df = spark.range(300).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x" * 10).alias("text"))
    rows = sharding.sharded(df, 100).collect()
    assert len(rows) == 300 and max(r.shard_bytes for r in rows) <= 100


def test_shards_of_nothing(empty, docs, tmp_path):
    assert sharding.sharded(empty, 100).count() == 0
    sharding.write_shards(docs, 200, str(tmp_path / "s"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "s")).count() == len(ROWS)
