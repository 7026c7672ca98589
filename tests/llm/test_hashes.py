"""Hashes and tables on texts made to collide: the Thue-Morse word and its complement, which every polynomial hash modulo a power of two takes for one."""

import zlib

import numpy as np
import pytest

from quillstack.llm import ngram_join, packing, quality, suffix_dedup, textscan, token_store, toxicity, word_tokens
from quillstack.llm.queries import tokenizer


def morse(n, a="a", b="b"):
    t = a
    while len(t) < n:
        t += t.translate({ord(a): b, ord(b): a})
    return t


def pair(n):
    return "q" * 8 + morse(n) + "q" * 8, "q" * 8 + morse(n, "b", "a") + "q" * 8


def test_span_hash_against_big_integers():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 200_000, dtype=np.uint8)
    start = np.sort(rng.integers(0, 199_000, 60))
    end = np.sort(np.maximum(start + rng.integers(0, 900, 60), start))
    start, end = np.append(start, [199_000, 199_100]), np.append(end, [199_100, 200_000])
    start[0], end[:1] = 0, end[0]
    end = np.maximum.accumulate(end)
    for base in (0, 1):
        want = []
        for a, z in zip(start.tolist(), end.tolist(), strict=True):
            v = 0
            for x in reversed(data[a:z].tolist()):
                v = (v * textscan._BASES[base] + x + 1) % textscan.PRIME
            want.append(v)
        mixed = textscan.mix(np.array(want, np.uint64) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        assert (textscan.span_hash(data, start, end, base) == mixed).all()
    big = textscan.span_hash(data, np.array([5, 70_000]), np.array([199_000, 199_500]))
    assert big[0] != big[1]
    a, b = rng.integers(0, textscan.PRIME, (2, 1000)).astype(np.uint64)
    got = textscan._times(a, b)
    assert [int(x) % textscan.PRIME for x in got] == [int(x) * int(y) % textscan.PRIME for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_colliding_words(spark, n):
    x, y = pair(n)
    docs = spark.createDataFrame([(1, f"{x} b c"), (2, f"{y} b c"), (3, f"{x}\n{y}\n{x}")], "doc_id long, text string")
    lib = word_tokens.encoder(tokenizer()).lib
    want = {i: np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in ((r.doc_id, r.text) for r in docs.collect())}
    pieces = packing.pack(docs, tokenizer(), width=1 << 20, end_id=1).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tobytes() for r in pieces} == want
    store = token_store.write(docs, tokenizer(), end_id=1)
    assert sorted(r.ids_crc32 for r in token_store.read_digests(spark, store).collect()) == sorted(map(zlib.crc32, want.values()))
    assert {r.doc_id: r.n_dup_lines for r in quality.document_statistics(docs).collect()} == {1: 0, 2: 0, 3: 1}
    linked = ngram_join.jaccard_components(docs.where("doc_id < 3"), k=3, num=90, den=100).collect()
    assert {(r.doc_id, r.component_id) for r in linked} == {(1, 1), (2, 2)}
    far = spark.createDataFrame([(1, "x" * 50 + x), (2, y + "z" * 50)], "doc_id long, text string")
    assert all(r.n_removed == brute_removed(t, [f for f in far.collect()], 200) for r, t in zip(suffix_dedup.remove_repeats(far, length=200).orderBy("doc_id").collect(), ["x" * 50 + x, y + "z" * 50], strict=True))


def brute_removed(text, rows, size):
    """Bytes of text covered by a string of ``size`` bytes that starts anywhere else, too."""
    seen: dict[str, int] = {}
    for r in rows:
        for i in range(len(r.text) - size + 1):
            seen[r.text[i : i + size]] = seen.get(r.text[i : i + size], 0) + 1
    gone = np.zeros(len(text), bool)
    for i in range(len(text) - size + 1):
        if seen[text[i : i + size]] > 1:
            gone[i : i + size] = True
    return int(gone.sum())


def test_pieces_whose_keys_all_agree_keep_their_ids(monkeypatch):
    """With every key alike, the table tells pieces apart by their bytes alone."""
    monkeypatch.setattr(word_tokens, "mix", lambda x: np.zeros_like(x))
    monkeypatch.setattr(word_tokens, "span_hash", lambda d, a, z: np.zeros(len(a), np.uint64))
    enc = word_tokens.Encoder(tokenizer())
    rng = np.random.default_rng(1)
    letters = list("abcdefgh")
    words = ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(150)]
    words += ["a" * 20 + w[:1] + "b" * 20 for w in words[:8]] + [x + "c" * 9000 for x in "ab"]
    text = " ".join(w for _ in range(2) for w in words)
    for _ in range(2):  # met for the first time, and again
        ids, _ends = enc.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == enc.lib.encode(text, add_special_tokens=False).ids


def test_toxicity_pairs_take_eight_bytes():
    rows = np.repeat(np.arange(50), 40)
    s = toxicity._Sample(rows, np.tile(np.arange(40), 50), 40, np.arange(50) % 2.0)
    for part, pairs in ((s, 2000), (s.take(np.array([3, 7])), 80), (s.only(np.array([5, 39])), 100)):
        assert len(part.row) == pairs and part.row.nbytes + part.term.nbytes == 8 * pairs
    assert s.take(np.array([3, 7])).row.tolist() == [0] * 40 + [1] * 40
    assert s.only(np.array([5, 39])).term.tolist() == [0, 1] * 50
