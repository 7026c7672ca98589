import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.llm import chat_repair, exact_dedup, mixing, ngram_join, quality, suffix_dedup, toxicity
from quillstack.llm.components import components

from .conftest import ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(t):
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_quality_statistics(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (8, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.verdicts(docs, labels).collect()
    assert len(rows) == len(ROWS)
    want = Counter((i, *brute_statistics(t or "")) for i, t, _ in ROWS)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    assert quality.verdicts(empty, labels).count() == 0
    assert all(r.kept != r.base_failed for r in quality.verdicts(docs, labels.where("false")).collect())


def test_trees_learn_and_keep_their_signs():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 10))
    y = ((x[:, 2] < 0.5) & (x[:, 0] > 0.3)).astype(float)
    noise = rng.random(3000) < 0.05
    y[noise] = 1 - y[noise]
    model = quality.fit(x, y)
    assert ((model.probability(x) > 0.5) == ((x[:, 2] < 0.5) & (x[:, 0] > 0.3))).mean() > 0.97
    grid = np.repeat(x[:50], 40, axis=0)
    for f, sign in enumerate(quality.FEATURES.values()):
        if sign:
            g = grid.copy()
            g[:, f] = np.tile(np.linspace(0, 1, 40), 50)
            steps = np.diff(model.margin(g).reshape(50, 40), axis=1) * sign
            assert (steps >= -1e-9).all()


def test_factorization_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(1500):
        a, b = (rng.random(2) < 0.5).tolist()
        terms = [1] * a + [2] * b + rng.choice(np.arange(100, 140), 3, replace=False).tolist()
        rows.append((np.array(sorted(terms)), int(a and b)))
    model = toxicity.fit(rows, 0.25)
    flat, row = np.concatenate([r[0] for r in rows]), np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    term = model.feature[flat]
    p = toxicity.sigmoid(model.margin(row[term >= 0], term[term >= 0], len(rows)))
    assert ((p > 0.5) == np.array([r[1] for r in rows])).mean() > 0.97


def test_factorization_machine_learns_an_exclusive_pair():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(2000):
        a, b = (rng.random(2) < 0.5).tolist()
        rows.append((np.array([1] * a + [2] * b + sorted(rng.choice(np.arange(100, 140), 3, replace=False).tolist())), int(a != b)))
    model = toxicity.fit(rows[:1500], 0.5)
    for terms, label in rows[1500:]:
        t = model.feature[terms]
        assert (brute_margin(model, t[t >= 0]) > 0) == label


def brute_margin(model, terms):
    """The written formula, pair by pair."""
    pairs = sum(float(model.v[i] @ model.v[j]) for k, i in enumerate(terms) for j in terms[:k])
    return model.bias + sum(float(model.w[i]) for i in terms) + pairs


def test_scores_follow_the_formula():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["alpha", "bet", "gamma", "idiots", "Moron", "x1y", "\u00e9t\u00e9"], 9)) for _ in range(60)] + ["", "..."]
    import pyarrow as pa

    from quillstack.llm.textscan import text_chunks

    ((_, _, data, offs),) = text_chunks(pa.array(texts))
    row, bucket = toxicity.term_buckets(data, offs)
    feature = np.full(toxicity.BUCKETS, -1, np.int32)
    some = np.unique(bucket)
    feature[some] = np.arange(len(some))
    model = toxicity.Machine(feature, -0.3, rng.normal(size=len(some)), rng.normal(size=(len(some), 8)))
    for i, got in enumerate(model.scores(data, offs)):
        assert abs(got - 1 / (1 + np.exp(-np.clip(brute_margin(model, feature[bucket[row == i]]), -40, 40)))) < 1e-9


def test_very_long_texts_are_scanned_in_runs(spark):
    """Runs, blocks and chunks end inside these texts."""
    import pyarrow as pa

    from quillstack.llm.textscan import span_hash, text_chunks, word_spans

    rng = random.Random(3)
    words = [rng.choice(["ab", "Cde", "\u00fcber", "x\ny", "12,3"]) + str(rng.randrange(900)) for _ in range(120_000)]
    text = " ".join(words)
    ((_, _, data, offs),) = text_chunks(pa.array([text]))
    assert len(data) > 3 * (1 << 18)
    s = quality.statistics(data, offs)
    assert tuple(int(s[c][0]) for c in quality.COUNTS[:5]) == brute_statistics(text)
    start, end, _ = word_spans(data, offs)
    raw = text.encode()
    for k in (0, 1):
        h = span_hash(data, start, end, k)
        seen = {}
        for a, z, x in zip(start.tolist(), end.tolist(), h.tolist()):
            assert seen.setdefault(raw[a:z], x) == x
        assert len(set(seen.values())) == len(seen)
    sets = ngram_join.shingle_sets(data, offs, 3)[0]
    w = WORD.findall(text.translate(LOWER))
    assert len(sets) == len({tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    terms = {m for m in re.findall(r"[a-z\u0080-\uffff]+", text.translate(LOWER))}
    terms |= {(n, t.encode()[:n]) for t in terms for n in toxicity.STEMS if len(t.encode()) > n}
    assert len(terms) - 3 <= len(toxicity.term_buckets(data, offs)[0]) <= len(terms)
    rows = [(1, text), (2, text[:500_000]), (3, "short")]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in out}
    n = len(text[:500_000].encode())
    assert gone == {1: (len(raw), n, 1), 2: (n, n, 1), 3: (5, 0, 0)}


def test_own_columns_keep_their_values(spark, tmp_path):
    clash = spark.createDataFrame([(1, "a b c d e f", "s", 7, 8, 9), (2, "a b c d e f", None, 7, 8, 9), (None, None, "s", None, None, None)], "doc_id long, text string, source string, _rid int, _place int, _slot int")
    for out in (exact_dedup.keep_first(clash), ngram_join.keep_one(clash), mixing.mixed_documents(clash)):
        assert out.columns == clash.columns
        assert {(r._rid, r._place, r._slot) for r in out.collect()} <= {(7, 8, 9), (None, None, None)}


def test_toxicity_by_brute_margin(spark, docs, empty):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choices(["the", "and", "of", "in"], k=20) + (["moron", "Idiot!"][i % 2 : 1 + i % 2] if i % 5 == 0 else []))) for i in range(400)]
    data = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    machine = toxicity.train(data, labels)
    rows = toxicity.score(data, machine).collect()
    assert all(r.predicted == (r.doc_id % 5 == 0) == (r.score >= 0.3) for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert toxicity.score(docs, machine).count() == len(ROWS) and toxicity.score(empty, machine).count() == 0
    assert toxicity.clean(docs, machine).columns == docs.columns
    none = toxicity.train(data, labels.where("false"))
    assert all(r.score < 1e-6 for r in toxicity.score(data, none).collect())


def brute_mix(rows):
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for n, (_, _, s) in zip(size, rows):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size), set(order), {}
    while True:
        rate = left / max(1, sum(weight[s] for s in open_))
        over = [s for s in open_ if rate * weight[s] > 2 * total[s]]
        if not over:
            return size, total, target | {s: rate * weight[s] for s in open_}
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
            open_.discard(s)


def test_mix_meets_its_targets(docs, empty):
    size, total, target = brute_mix(ROWS)
    rows = mixing.taken(docs, block=64).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, n) for n, (i, _, _) in zip(size, ROWS))
    assert {round(r.target, 6) for r in rows} == {round(t, 6) for t in target.values()}
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[round(r.target, 6), r.source_size] += r.taken
    alike = Counter((round(t, 6), total[s]) for s, t in target.items())
    assert all(abs(n - t * alike[t, m]) <= alike[t, m] for (t, m), n in taken.items())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.taken(docs, block=64).collect()))
    assert mixing.taken(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_schedule_is_even(spark):
    df = spark.createDataFrame([(i, "w " * 20, "abc"[i % 3]) for i in range(900)], "doc_id long, text string, source string")
    sizes, targets, pieces = mixing.mix(df, block=50)
    slots = pieces.join(sizes, "row_id").groupBy("slot").agg(F.min("source").alias("source"), F.sum("words").alias("words")).orderBy("slot").collect()
    share = {r.source: r.target for r in targets.collect()}
    whole = sum(share.values())
    assert all(r.words <= 50 for r in slots[:-3])
    done = Counter()
    for n, r in enumerate(slots, 1):
        done[r.source] += 1
        assert all(abs(done[s] - n * t / whole) < 4 for s, t in share.items())


def brute_spans(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                m[i : i + length] = b"\1" * length
        out.append((str(d), len(b), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [1 << 16, 5])
def test_suffix_dedup(spark, hot):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choices(["alpha", "bé", "gamma", "x", "delta"], k=n))
    base = [words(80) for _ in range(4)]
    rows = [(i, words(rng.randrange(60)) + " " + rng.choice(base)[rng.randrange(120) :][: rng.randrange(150, 400)] + words(rng.randrange(30))) for i in range(40)]
    rows += [(40, "ab" * 300), (41, "a" * 700), (42, None), (43, ""), (44, base[0]), (45, base[0]), (48, "z" * 199), (49, "q" * 200), (50, "q" * 200), (50, "q" * 200), (None, base[1])]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect())
    assert got == brute_spans(rows, 200)


def test_suffix_dedup_edges(docs, empty):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == brute_spans([(i, t) for i, t, _ in ROWS], 200)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_deep_shallow_sorts():
    rng = random.Random(2)
    for _ in range(100):
        xs = list({bytes(rng.choices(b"ab", k=rng.randrange(0, 40))) for _ in range(rng.randrange(1, 30))})
        assert [xs[i] for i in suffix_dedup.deep_shallow(xs, 0, 8)] == sorted(xs)


LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_components(rows, k, num):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= num * (len(sets[a]) + len(sets[b]) - n):
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), len(sets[i]), least.get(root(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "num", "tile"), [(3, 90, 512), (3, 90, 4), (5, 80, 512), (5, 80, 4)])
def test_ngram_join(spark, k, num, tile):
    rng, rows = random.Random(5), []
    voc = ["W%d" % i for i in range(60)]
    for i in range(180):
        if i % 4 == 0:
            t = " ".join(rng.choices(voc, k=rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 12, 14, 20, 25, 40, 80, 120, 300])))
        else:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(voc)
            t = " ".join(w)
        rows.append((i, t))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=k, num=num, tile=tile).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == brute_components(rows, k, num)


def test_ngram_join_edges(docs, empty):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect())
    assert sorted(map(str, got)) == sorted(map(str, brute_components([(i, t) for i, t, _ in ROWS], 3, 90)))
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 4, 5, 6, 6, 7, 8, 9, 10]
    assert ngram_join.jaccard_components(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(-5, 200)]
    up = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: m for x, m in up.items() if any(x in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("chunk", [3, 4096])
def test_chat_repair(spark, chunk):
    rng, rows = random.Random(2), []
    for c in range(40):
        for t in range(rng.randrange(1, 8) if c else 40):
            rows.append((c if c < 38 else None, t if rng.random() < 0.9 else 3, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, " User"]), rng.choice(["a", "b c", None, ""])))
    rng.shuffle(rows)
    out = chat_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chunk=chunk)
    by = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: r.place):
        by[r.conv_id].append(r)
    for c, rs in by.items():
        given = [r for r in rs if r.action != "insert"]
        assert len(given) == sum(x[0] == c for x in rows)
        best = {0: 0}
        for role in chat_repair._role_numbers([g.given_role for g in given]).tolist():
            best = {t: min(n + chat_repair.step(s, role, t)[0] for s, n in best.items()) for t in (1, 2, 3)}
        assert sum(r.cost for r in rs) == min(n + 3 * len(chat_repair.ENDINGS[s]) for s, n in best.items())
        text = "".join(r.rendered for r in rs)
        assert re.fullmatch("s?(ua)+", "".join(x[0] for x in re.findall(r"<\|(\w+)\|>\n", text) if x != "end")) and text.endswith("<|end|>\n")
    assert out.sparkSession.createDataFrame([], "conv_id long, turn long, role string, text string").transform(chat_repair.repair).count() == 0
    assert chat_repair.rendered(out).count() == len(by)


def test_ngram_join_shuffles_packed_keys_and_few_texts(spark, monkeypatch):
    """Keys are neither written nor shuffled as rows, and a text that no other shares a key with stays where it is."""
    saved, save = {}, ngram_join.scratch.save
    monkeypatch.setattr(ngram_join.scratch, "save", lambda df, tag, *x: (saved.setdefault(tag, df), save(df, tag, *x))[1])
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["w%d" % j for j in range(5000)], k=200))) for i in range(30)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(3)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))
    assert not any(f.dataType.typeName() == "array" for df in saved.values() for f in df.schema.fields)
    for df in (saved["members"], kept):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan and "strategy=broadcast" in plan


def test_edges_of_packed_keys():
    """Sets that meet in one task or in two are connected, each set counts a key once, and packing keeps every number."""
    rng = np.random.default_rng(4)
    key, sets = rng.integers(0, 400, 1500).astype(np.uint64) * np.uint64(1 << 55), rng.integers(-300, 300, 1500)
    whole = ngram_join._meet(key, sets, np.zeros(1500, bool))[1]
    halves = [ngram_join._meet(key[i::2], sets[i::2], np.zeros(750, bool)) for i in (0, 1)]
    joined = ngram_join._meet(*(np.concatenate([h[0][c] for h in halves]) for c in range(3)))[1]

    def parts(*edges):
        up = {}
        find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
        for a, b, _ in edges:
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                up[max(find(x), find(y))] = min(find(x), find(y))
        return {x: find(x) for x in up}

    assert parts(whole) == parts(*(h[1] for h in halves), joined)
    held = {}
    for k, s in zip(key.tolist(), sets.tolist(), strict=True):
        held.setdefault(k, set()).add(s)
    want = Counter(s for one in held.values() if len(one) > 1 for s in one)
    a, b, n = whole
    assert {x: m for x, y, m in zip(a.tolist(), b.tolist(), n.tolist(), strict=True) if x == y} == want
    ids = np.unique(sets)
    assert (ngram_join._unplaned(ngram_join._planes(ids), np.int64) == ids).all()
    assert (ngram_join._unplaned(ngram_join._planes(np.sort(key)), np.uint64) == np.sort(key)).all()
