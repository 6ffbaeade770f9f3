import numpy as np
import pytest
from pyspark.sql import functions as F

from scorekit.llm import pu_quality as X


def sets(seed, prior, n=4000, gap=2.5):
    dice = np.random.default_rng(seed)
    good = lambda k: dice.normal(gap / 2, 1, (k, 4)).astype(np.float32)
    bad = lambda k: dice.normal(-gap / 2, 1, (k, 4)).astype(np.float32)
    unl = np.concatenate([good(int(n * prior)), bad(n - int(n * prior))])
    return good(n), unl, good(n), bad(n)


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_prior_and_fit_without_negatives(prior):
    pos, unl, good, bad = sets(int(prior * 10), prior)
    first = X.discriminate(pos, unl)
    count = lambda x: np.bincount((first.scores(x) * (X.BINS - 1)).astype(int), minlength=X.BINS)
    found = X.class_prior(count(good), count(unl))
    assert abs(found - prior) < 0.07
    model = X.fit(pos, unl, found)
    assert (model.scores(good) >= 0.5).mean() > 0.9 and (model.scores(bad) < 0.5).mean() > 0.85
    _, negative = X.risk(np.log(1 / (1 / model.scores(pos) - 1)), np.log(1 / (1 / model.scores(unl) - 1)), found)
    assert negative > -0.02  # the estimate of the negatives' risk is held at zero or above


def test_risk_is_the_definition():
    dice = np.random.default_rng(0)
    p, u, pi = dice.normal(size=9), dice.normal(size=7), 0.4
    loss = lambda z: np.log(1 + np.exp(-z))
    first, second = X.risk(p, u, pi)
    assert np.isclose(first, pi * loss(p).mean()) and np.isclose(second, loss(-u).mean() - pi * loss(-p).mean())


def test_a_small_sample_does_not_drive_the_risk_below_zero():
    dice = np.random.default_rng(1)
    pos, unl = dice.normal(0.3, 1, (30, 200)), dice.normal(0, 1, (30, 200))  # separable by chance
    model = X.fit(pos, unl, 0.7)
    z = lambda x: x @ model.weights + model.intercept
    assert X.risk(z(pos), z(unl), 0.7)[1] > -0.1


def test_held_out_labels_of_the_table(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = X.learn(docs, labels)
    out = X.predict_quality(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    share = labels.where("quality is not null").agg(F.avg("quality")).first()[0]
    assert abs(model.prior - share) < 0.05
    assert (out.predicted == out.quality).mean() > 0.99
    assert (out.predicted[out.quality == 0] == 0).mean() > 0.97
    assert ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_held_out_rows_teach_nothing(spark, real_docs):
    labels = real_docs.select("doc_id", (F.length("text") % 2).alias("quality")).where("doc_id is not null")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    a = X.learn(real_docs, labels)
    b = X.learn(real_docs.withColumn("text", F.when(out, "other").otherwise(F.col("text"))),
                labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert np.allclose(a.weights, b.weights, atol=1e-4) and a.prior == b.prior


def test_features_are_of_the_whole_text_and_do_not_depend_on_blocks(monkeypatch):
    text = "Some words, SOME!! words *** 12 more\n\nwörds " * 50
    whole = X.Features().row(text)
    assert whole.shape == (X.WIDTH,) and not X.Features().row("").any()
    monkeypatch.setattr(X, "BLOCK", 1 << 10)
    halves = X.Features().row(text)
    assert np.abs(halves - whole).max() < 0.05  # a run cut by a block's end counts twice
    assert not np.array_equal(X.Features().row(text + "?" * 9), whole)


def test_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(14)] + [(None, 1), (3, None), (5, 0), (99, 1)],
                                   "doc_id long, quality int")
    model = X.learn(edge_docs, labels)
    rows = X.predict_quality(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    for same in ({r["score"] for r in rows if r["doc_id"] == 9}, {r["score"] for r in rows if r["doc_id"] in (0, 1)}):
        assert len(same) == 1
    assert X.predict_quality(no_docs, model).count() == 0
    for none in (X.learn(edge_docs, labels.where("false")), X.learn(no_docs, labels), X.learn(edge_docs, labels.where("quality = 0"))):
        assert {r["score"] for r in X.predict_quality(edge_docs, none).collect()} == {0.0}
