"""Every stage's rows against a brute-force version of it, on its own input."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillstack.llm import queries, toxicity
from quillstack.llm.textscan import text_chunks

from .test_text_ops import brute_components, brute_margin, brute_mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _rid int, size string, label int, slot string"


def _documents():
    """Plain and toxic texts, exact and near copies, null, empty and blank texts, a repeated row, a long text, null sources."""
    rng, rows = random.Random(11), []
    voc = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("b", "d", "g", "st", "x", "nd", "r", "lk")]
    for i in range(260):
        words = rng.choices(voc, k=rng.choice([0, 1, 3, 4, 5, 8, 20, 60]))
        if i % 6 == 0:
            words.insert(rng.randrange(len(words) + 1), rng.choice(["moron", "Idiots!"]))
        elif i % 7 == 1 and rows:
            words = rng.choice([r for r in rows if r[1].count(" ") > 50] or rows)[1].split(" ") if i % 2 else rng.choice(rows)[1].split(" ")
            if i % 2:
                words[rng.randrange(len(words))] = "qq"
        rows.append([i, " ".join(words), "en", rng.choice(["web", "books", "code", None])])
    rows[20][1] = rows[21][1] = None
    rows[22][1], rows[23][1] = " \t\n", "a <|endoftext|>　b  中文"
    rows.append([260, " ".join(rng.choices(voc, k=70_000)), None, "web"])
    rows.append(list(rows[25]))
    return [(*r, len(r[1] or ""), r[0] % 3, "s", None, "x") for r in rows]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(_documents(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i % 6 == 0)) for i in range(0, 256)] + [(None, None, None), (3, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def _rows(df):
    return Counter(map(tuple, df.collect()))


def _first(rows, group):
    """Of rows with equal groups the one with the smallest doc_id; a group of None stays."""
    out, held = Counter(), {}
    for r in rows.elements():
        g = group(r)
        if g is None:
            out[r] += 1
        elif g not in held or r[0] < held[g][0]:
            held[g] = r
    return out + Counter(held.values())


def brute_clean(spark, rows, sf):
    machine = toxicity.train(spark.createDataFrame(list(rows.elements()), SCHEMA), queries.table(spark, sf, "labels"))
    out = Counter()
    for r, n in rows.items():
        ((_, _, data, offs),) = text_chunks(pa.array([r[1] or ""]))
        term = machine.feature[toxicity.term_buckets(data, offs)[1]]
        if 1 / (1 + np.exp(-brute_margin(machine, term[term >= 0]))) < 0.3:
            out[r] = n
    return out


def brute_near(rows):
    rows = sorted(rows.elements(), key=lambda r: r[0])
    found = {int(d): c for d, _, c in brute_components([(r[0], r[1]) for r in rows], 5, 80)}
    return Counter(r for r in rows if found[r[0]] == r[0])


def brute_mixed(rows):
    rows = list(rows.elements())
    size, total, target = brute_mix([(r[0], r[1], r[3]) for r in rows])
    out = Counter()
    for s in total:
        at, need = 0, int(target[s] + 1e-9)
        own = [(int(hashlib.md5(str(r[0]).encode()).hexdigest()[:7], 16), r[0], n, r) for n, r in zip(size, rows, strict=True) if r[3] == s and n]
        for _, _, n, r in sorted(own, key=lambda x: x[:2]):
            for turn in (0, 1):
                out[r] += at + turn * total[s] < need
            at += n
    return +out


def brute_packed(rows, pieces):
    """The pieces put together again are the library's ids of every row, in whole sequences."""
    library = Tokenizer.from_file(queries.tokenizer())
    want = Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids) + (1,)) for r in rows.elements())
    got, fill, open_ = Counter(), defaultdict(int), []
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert p.start == len(open_) and p.length == len(ids) and p.offset == fill[p.sequence_id]
        fill[p.sequence_id] += p.length
        open_ += ids
        if len(open_) == p.doc_tokens:
            got[p.doc_id, tuple(open_)] += 1
            open_ = []
    assert not open_ and got == want
    assert sorted(fill) == list(range(len(fill))) and all(fill[i] == 2048 for i in range(len(fill) - 1))


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = queries.table(spark, sf, "documents")
    assert docs.count() == 262
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before, columns = _rows(docs), docs.columns
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            brute_packed(before, docs.collect())
            break
        assert docs.columns == columns
        after = _rows(docs)
        if name == "toxicity":
            assert after == brute_clean(spark, before, sf)
            toxic = [r for r in before if re.search("moron|Idiots!", r[1] or "")]
            assert len(toxic) > 40 and not any(r in after for r in toxic) and sum(after.values()) == 262 - sum(before[r] for r in toxic)
        elif name == "exact_dedup":
            assert after == _first(before, lambda r: re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""))
        elif name == "ngram_join":
            assert after == brute_near(before)
        else:
            assert after == brute_mixed(before)
        kept.append(sum(after.values()))
    assert kept[0] > kept[1] > kept[2] > 0
    pieces = lambda df: Counter((r.doc_id, r.start, bytes(r.ids), r.sequence_id, r.offset) for r in df.collect())
    assert pieces(corpus_pipeline.run(spark, sf)) == pieces(docs)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None, None, None, None)] * 2 + [(None, "a b c d e f", None, None, None, 1, "x", 2, None), (7, "a b c d e f", "en", "s", 1, 1, "x", 2, None)]])
def test_empty_tables_and_nulls_in_every_column(spark, tmp_path, rows):
    """A null id stays null; null texts are one text; of equal texts with an id among them the one with the id stays."""
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, ids = queries.table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        ids.append(sorted(str(r.doc_id) for r in docs.collect()))
    assert ids == ([["7", "None", "None", "None"], ["7", "None"], ["7", "None"], ["7", "7"], ["7", "7"]] if rows else [[]] * 5)
