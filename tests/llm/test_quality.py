from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from panelspark.llm.quality import estimate_prior, features, fit, keep_quality, score_quality

from .rows import ODD, frame

SF = "/root/testdata/sf0.1"


def test_features_of_odd_texts_are_finite():
    x = features(pa.array(ODD + ["word " * 50000], pa.string()))
    assert len(x) == len(ODD) + 1 and np.isfinite(x).all()
    together = features(pa.array(["a b c", "zz zz\nzz zz"]))
    assert np.allclose(together, np.concatenate([features(pa.array(["a b c"])), features(pa.array(["zz zz\nzz zz"]))]))


def test_risk_and_prior_on_two_clouds():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(2, 1, (9000, 4)), rng.normal(-2, 1, (4000, 4))
    unlabelled = np.concatenate([good[3000:], bad[:2000]])
    net, prior = fit(good[:3000], unlabelled)
    assert abs(prior - 0.75) < 0.08
    assert (net.scores(good[3000:]) > 0.7).mean() > 0.97 and (net.scores(bad[2000:]) < 0.5).mean() > 0.97
    everything = np.concatenate([good[:3000], unlabelled])
    assert abs(estimate_prior(everything.mean(0), everything.std(0), good[:3000], unlabelled) - 0.75) < 0.05


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = score_quality(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    right = [r.predicted == r.quality for r in held]
    bad = [r for r in held if r.quality == 0]
    assert len(bad) > 50 and np.mean(right) > 0.98 and np.mean([r.predicted == 0 for r in bad]) > 0.9


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0), (3, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, "a b", 0, "r"), (None, None, 1, "r"), (2, "", 1, None), (2, "", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int, row string")
    got = score_quality(docs, labels).collect()  # id 1 is labelled both ways, so there is no trusted positive
    assert len(got) == 4 and all(r.score == 1 and r.predicted == 1 for r in got)
    assert sorted(map(str, keep_quality(docs, labels).collect())) == sorted(map(str, docs.collect()))
    empty = frame(spark, [], partitions=1)
    assert score_quality(empty, labels).collect() == [] and keep_quality(empty, labels).columns == empty.columns


def risk(net, positive, unlabelled, prior):
    """The risk, term by term."""
    loss = lambda g: np.log1p(np.exp(-g))
    gp, gu = net.logits(net.inputs(positive)), net.logits(net.inputs(unlabelled))
    return prior * loss(gp).mean() + max(0.0, loss(-gu).mean() - prior * loss(-gp).mean())


def test_training_finds_a_lower_risk_than_nearby_networks():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (3000, 3)), rng.normal(-1, 1, (1500, 3))
    unlabelled = np.concatenate([good[1000:], bad])
    net, prior = fit(good[:1000], unlabelled, steps=800, batch=256)
    least = risk(net, good[:1000], unlabelled, prior)
    kept = [w.copy() for w in net.weights]
    for size in (0.3, 1.0):
        for _ in range(10):
            net.weights = [w + size * rng.standard_normal(w.shape) for w in kept]
            assert risk(net, good[:1000], unlabelled, prior) > least - 0.02
    net.weights = [0 * w for w in kept]
    assert risk(net, good[:1000], unlabelled, prior) > least + 0.1


def test_ids_repeated_many_times_come_as_one_row(spark):
    """An id with hundreds of rows is one of the sample, and scores are those of each row's own text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(400)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    many = docs.union(docs.where("doc_id % 50 = 1").crossJoin(spark.range(200)).select("doc_id", "text"))
    got = {(r.doc_id, round(r.score, 9)) for r in score_quality(many, labels).collect()}
    assert got == {(r.doc_id, round(r.score, 9)) for r in score_quality(docs, labels).collect()}
