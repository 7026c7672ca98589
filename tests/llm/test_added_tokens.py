"""Ids of texts with literals of added tokens, against the library as it comes from the file."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

import corpus_pipeline
from quillstack.llm import packing, queries
from quillstack.llm.textscan import text_chunks
from quillstack.llm.word_tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"


def encoded(enc, texts):
    out = []
    for _, _, data, offs in text_chunks(pa.array(texts), 256):
        ids, ends = enc.encode(data, offs)
        out += [x.tolist() for x in np.split(ids, ends[:-1])]
    return out


def texts(literals):
    rng = random.Random(5)
    parts = [*literals, *literals, "a", " b", " ", "\n", "  ", "don't", ".x", "é", "　", "<|", "|>", "<|endof", "text|>", "\t"]
    return [END, END * 2, f"a {END} b", f"a{END}b", f"x \n{END}\n\n y ", "<|endof", "text|>", "", *("".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(600))]


def test_literals_are_the_librarys_tokens():
    lib, enc, rows = Tokenizer.from_file(PATH), Encoder(PATH, added=True), texts([END])
    assert encoded(enc, [f"a {END} b"]) == [[64, 220, 50256, 275]]
    for _ in range(2):
        assert encoded(enc, rows) == [lib.encode(t, add_special_tokens=False).ids for t in rows]


def test_several_added_tokens(tmp_path):
    lib, more = Tokenizer.from_file(PATH), ["<|endof", "é|", "b<|"]
    lib.add_special_tokens([AddedToken(x, normalized=False) for x in more])
    lib.save(path := str(tmp_path / "t.json"))
    lib, enc, rows = Tokenizer.from_file(path), Encoder(path, added=True), texts([END, *more])
    assert encoded(enc, rows) == [lib.encode(t, add_special_tokens=False).ids for t in rows]
    lib.add_tokens([AddedToken("two words")])
    lib.save(path)
    with pytest.raises(ValueError):
        Encoder(path, added=True)


def test_registered_queries_match_literals(spark, tmp_path):
    docs = spark.createDataFrame([(1, f"a {END} b"), (2, "plain")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    lib = Tokenizer.from_file(PATH)
    want = [lib.encode(t, add_special_tokens=False).ids for t in (f"a {END} b", "plain")]
    crc = lambda end: {i + 1: F.crc32(F.lit(np.array([*x, end], "<u4").tobytes())) for i, x in enumerate(want)}
    for query, end in ((queries.op1_pack, 1), (queries.op2_token_store, 2)):
        got = {r.doc_id: r.ids_crc32 for r in query(spark, str(tmp_path)).collect()}
        assert got == {i: spark.range(1).select(c).first()[0] for i, c in crc(end).items()}
    stage = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in corpus_pipeline.pack(spark, docs, "").collect()}
    assert stage == {i + 1: [*x, 1] for i, x in enumerate(want)}
    assert {r.doc_id: r.doc_tokens for r in packing.pack(docs, PATH).collect()}[1] == 10  # without added, the literal is plain text
