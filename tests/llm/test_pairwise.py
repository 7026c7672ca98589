"""The pairwise ranking: its fit, its cut, odd rows, and held-out accuracy."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from quillstack.llm import pairwise, quality, queries

SF = "/root/testdata/sf0.01"


def test_pairs_are_ordered_and_the_loss_is_at_its_least():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 10))
    y = (x[:, 0] - np.abs(x[:, 1]) + 0.3 * rng.normal(size=1500) > -0.5).astype(float)
    s = pairwise.fit(x, y).strength(x)
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.97
    diff = rng.normal(size=(400, 3)) + 0.4
    w = pairwise._newton(diff, np.full(400, 1 / 400), 1e-3)

    def loss(w):
        return np.logaddexp(0, -(diff @ w)).mean() + 1e-3 / 2 * w @ w

    assert all(loss(w) <= loss(w + rng.normal(0, 0.05, 3)) for _ in range(200))


def test_one_label_or_none():
    x = np.zeros((3, 10))
    assert not pairwise.fit(x, np.ones(3)).weights.any() and not pairwise.fit(x[:0], np.zeros(0)).weights.any()


def test_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (8, None, 0), (7, 0, 1), (2, 1, 1), (2, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = pairwise.score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 6}) == 1
    assert pairwise.score(empty, labels).count() == 0
    assert {r.predicted for r in pairwise.score(docs, labels.where("false")).collect()} == {1}
    assert {r.predicted for r in pairwise.score(docs, labels.where("quality = 0")).collect()} == {0}


def test_held_out_documents_and_the_cut(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op13_quality_ranking(spark, SF).toPandas()
    assert len(got) == docs.count() and got.doc_id.is_unique
    seen = got.merge(labels.toPandas(), on="doc_id").dropna(subset=["quality"])
    held = seen[seen.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert len(bad) > 5 and (good[:, None] > bad[None, :]).mean() > 0.98 and (held.predicted == held.quality).mean() > 0.95
    learn = seen[~seen.held_out]
    assert (learn.predicted == 0).sum() == (learn.quality == 0).sum()  # the cut is that quantile
    other = labels.withColumn("quality", F.when(pairwise.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = pairwise.score(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), other).toPandas()
    assert np.allclose(again.sort_values("doc_id").score, got.sort_values("doc_id").score)  # held-out labels, language and source say nothing


def test_scores_by_hand(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    stats = quality.document_statistics(docs)
    model, cut = pairwise.train(stats, labels)
    got = {r.doc_id: r.score for r in pairwise.score(docs, labels).collect()}
    for r in stats.limit(50).collect():
        x = pairwise.features({c: np.array([float(r[c])]) for c in quality.COUNTS})[0]
        z = [min(8, max(-8, (a - m) / s)) for a, m, s in zip(x, model.middle, model.spread, strict=True)]
        phi = z + [max(0, a - k) for row in model.knots for a, k in zip(z, row, strict=True)]
        margin = sum(a * w for a, w in zip(phi, model.weights, strict=True)) - cut + np.log(0.3 / 0.7)
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-margin))) < 1e-9
