"""Whitening and hard negatives against brute force, with nulls, non-finite entries, repeats, ties, short vectors, clashing columns and empty tables."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.llm import hard_negatives, queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def vectors(spark, rows):
    """With columns whose names clash with those the operators use inside."""
    extra = {c: F.lit(1) for c in ("x", "d", "w", "n", "component", "rid", "kind", "list", "block", "v", "lo")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(extra)


def made(seed, n=300, width=6):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(0, 1, width) * (1 + np.arange(width))).round(3).tolist(), int(rng.integers(4))) for i in range(n)]
    rows += [(900, None, 1), (901, [1.0, None, 0.5, 0.0, 0.0, 0.0], 1), (902, [math.nan] * width, 2), (903, [math.inf] + [0.0] * (width - 1), 2), (None, rows[5][1], 3), (905, rows[6][1], None)]
    rows += [rows[50], rows[50], rows[100], (907, rows[50][1], rows[50][2]), (908, rows[50][1], (rows[50][2] + 1) % 4), (909, rows[7][1][:3], 0), (950, [0.0] * width, 1)]
    return rows


def usable(row):
    return row[1] is not None and all(c is not None and math.isfinite(c) for c in row[1])


def integers(rows, scale, shift=0):
    width = max((len(r[1]) for r in rows), default=0)
    return [[math.floor(scale * c) + shift for c in r[1]] + [shift] * (width - len(r[1])) for r in rows]


def test_whitening_against_numpy(spark):
    rows = made(1)
    kept = [r for r in rows if usable(r)]
    x = integers(kept, 64, 1_000_000)
    n, width = len(x), len(x[0])
    sums = [sum(c) for c in zip(*x, strict=True)]
    d = [[n * a - s for a, s in zip(row, sums, strict=True)] for row in x]
    centred = np.array(d, float) / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    want = centred @ v / np.sqrt(e)
    got = whitening.whiten(vectors(spark, rows), components=32).collect()
    assert len(got) == n * width and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, width + 1))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    by = {c: sorted((r for r in got if r.component == c), key=lambda r: (r.vec_id is None, r.vec_id, r.deviation)) for c in range(1, width + 1)}
    order = sorted(range(n), key=lambda i: (kept[i][0] is None, kept[i][0], sum(t * t for t in d[i])))
    for c in range(width):
        values = np.array([r.whitened for r in by[c + 1]])
        assert np.allclose(values, want[order, c] * np.sign(values @ want[order, c]), atol=1e-9)
        assert all(abs(r.explained / (e[c] / np.trace(cov)) - 1) < 1e-9 for r in by[c + 1])
        assert [int(r.deviation) for r in by[c + 1]] == [sum(t * t for t in d[i]) for i in order]


def test_whitening_leaves_out_components_without_variance(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [*x, x[0] - x[1], 2.0], 0) for i, x in enumerate(rng.integers(-50, 50, (80, 3)).astype(float).tolist())]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3} and len(got) == 240
    assert abs(sum(r.explained for r in got) / 80 - 1) < 1e-9 and got[0].identity_error < 1e-6
    few = whitening.whiten(vectors(spark, rows[:3])).collect()
    assert {r.component for r in few} == {1, 2} and few[0].identity_error < 1e-6
    assert whitening.whiten(vectors(spark, rows[:1] * 3)).count() == 0
    for none in ([], [(1, None, 1)], [(1, [], 1)]):
        assert whitening.whiten(vectors(spark, none)).count() == 0


def test_deviations_beyond_64_bits_stay_exact():
    d = np.array([[3_000_000_000, 4_000_000_000], [1, 2]])
    assert [int(x) for x in whitening._square_sums(d).to_pylist()] == [25 * 10**18, 5]


def brute(rows, every=50, scale=256):
    kept = [r for r in rows if usable(r) and r[0] is not None and r[2] is not None]
    v = integers(kept, scale)
    out = []
    for i, (a, _, label) in enumerate(kept):
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v[i], v[j], strict=True)), kept[j][0], kept[j][2]) for j in range(len(kept)) if j != i)
        for minus, p, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 50 * -minus <= 100 * -s[0] <= 95 * -minus][:3]
            out += [(a, p, k + 1, s[1], -minus, -s[0]) for k, s in enumerate(fits)]
    return Counter(out)


def mined(spark, rows, **size):
    return Counter(tuple(r) for r in hard_negatives.mine(hard_negatives.build(vectors(spark, rows), **size), spark).collect())


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    rows = made(3)
    want = brute(rows)
    assert len(want) > 40 and mined(spark, rows) == want
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)  # lists of many blocks
    monkeypatch.setattr(hard_negatives, "TILE", 4)
    assert mined(spark, rows) == want


def test_lists_are_skipped_by_their_bounds_and_nothing_is_lost(spark, monkeypatch):
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 3, (8, 5))
    rows = [(i, (middle[i % 8] + rng.normal(0, 0.05, 5)).tolist(), int(rng.integers(3))) for i in range(4096)]
    index = hard_negatives.build(vectors(spark, rows))
    s = index.shape
    assert len(s.centroids) == 8
    a = np.array(integers(rows[::50], 256), float)
    low, high = s.bounds(a)
    each = index.rows.toPandas()
    for number, group in each.groupby("list"):
        x = np.stack([np.frombuffer(b, s.dtype) for b in group.v]).astype(float)
        scores = a @ x.T
        assert (scores <= high[:, [number]]).all() and (scores >= low[:, [number]]).all()
    seen = []
    visits = hard_negatives._visits
    monkeypatch.setattr(hard_negatives, "_visits", lambda *x: (seen.append(visits(*x)), seen[-1])[1])
    assert mined(spark, rows) == brute(rows)
    assert sum(v.count() for v in seen[:2]) < 0.5 * len(a) * 8  # of positives: most lists are never visited


def test_hard_negatives_of_little(spark):
    same = [(50 * i, [1.0, 2.0], 1) for i in range(6)]
    for rows in ([], [(1, None, 1)], [(50, [], 1), (51, [], 2)], same, [(3, [1.0], 1), (4, [1.0], 2)]):
        assert mined(spark, rows) == brute(rows)
    ties = [(i, [1.0, 1.0], 0) for i in range(0, 120)] + [(i, [0.7, 0.7], 1) for i in range(120, 240)]
    assert mined(spark, ties) == brute(ties)
    with pytest.raises(ValueError, match="scale"):
        mined(spark, [(50, [1e9, 1.0], 0)])


def test_registered_queries(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    changed = [(i, e, (y + 1) % 10 if i % 7 == 0 else y) for i, e, y in rows]
    got = queries.op12_hard_negatives(spark, SF)
    assert Counter(tuple(r) for r in got.collect()) == brute(changed)
    white = queries.op11_whiten(spark, SF)
    assert dict(white.dtypes)["deviation"] == "bigint" and white.count() == 32 * sum(map(usable, rows))
