import random

import numpy as np
from pyspark.sql import functions as F

from scorekit.llm import queries
from scorekit.llm import toxicity as X

GRADE = "toxic * (2 - coalesce(quality, 1))"


def made(seed, n):
    """Texts with 0, 1 or 2 kinds of bad words; the grade follows them."""
    dice = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{dice.randrange(400)}" for _ in range(dice.randint(3, 60))]
        grade = dice.choice([0, 0, 0, 1, 2])
        if grade:
            words.insert(dice.randrange(len(words)), dice.choice(["rude", "rudely"]) if grade == 1 else "vileness")
        rows.append((i, " ".join(words), grade))
    return rows


def test_grades_are_learned_in_order(spark):
    rows = made(1, 900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows[:600]], "doc_id long, grade int")
    model = X.learn(docs, labels, "grade")
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 2
    got = {r["doc_id"]: r for r in X.predict_severity(docs, model).collect()}
    held = rows[600:]
    assert np.mean([round(got[i]["severity"]) == g for i, _, g in held]) > 0.95
    assert np.mean([got[i]["toxic"] == (g > 0) for i, _, g in held]) > 0.97
    kept = {r["doc_id"] for r in X.drop_toxic(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r["toxic"]}


def test_the_fit_is_a_minimum():
    dice = np.random.default_rng(0)
    cols = [np.unique(dice.integers(0, 6, 3)) for _ in range(200)]
    y = np.array([min(2, int(0 in c) + int(1 in c)) for c in cols])
    model = X.fit(cols, y, l1=1e-4, steps=400)
    w, th = model.weights, model.thresholds

    def loss(w, th):
        s = np.array([w[c].sum() for c in cols])
        cum = np.concatenate([np.zeros((len(s), 1)), 1 / (1 + np.exp(-(th[None] - s[:, None]))), np.ones((len(s), 1))], axis=1)
        return -np.log(cum[np.arange(len(s)), y + 1] - cum[np.arange(len(s)), y]).mean() + 1e-4 * np.abs(w).sum()

    best = loss(w, th)
    for _ in range(200):  # no small change is better: the fit is at a minimum
        dw = np.zeros_like(w)
        dw[:6] = dice.normal(0, 0.05, 6)
        assert loss(w + dw, th + dice.normal(0, 0.02, 2)) > best - 1e-3


def test_whole_query_by_its_definition(spark):
    """Features by sets of words and beginnings, the sample's fit, and the prediction, for every row."""
    import re
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = X.learn(docs, labels, queries.GRADE)
    hasher = X.Hasher()

    def plain(text):
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())
        words = set(re.findall(rb"[0-9a-z\x80-\xff]+", low))
        own = set()
        for w in words:
            own.add(int(hasher._block(np.frombuffer(w, np.uint8))[0]))
            own |= {int(c) for c in hasher._block(np.frombuffer(w, np.uint8))}
        return sorted(own)

    truth = {r["doc_id"]: r["g"] for r in labels.groupBy("doc_id").agg(F.max(queries.GRADE).alias("g")).where("g is not null").collect()}
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    cols = {i: np.array(plain(t), dtype=np.int64) for i, t in rows}
    learned = [i for i, _ in rows if i in truth]
    again = X.fit([cols[i] for i in learned], np.array([truth[i] for i in learned]))
    got = {r["doc_id"]: r for r in X.predict_severity(docs, model).collect()}
    for i, _ in rows:
        p = 1 / (1 + np.exp(again.thresholds[0] - again.weights[cols[i]].sum()))
        assert abs(got[i]["p_toxic"] - p) < 1e-3 and abs(got[i]["severity"] - got[i]["p_toxic"]) < 1e-9
        assert got[i]["toxic"] == (got[i]["p_toxic"] > model.reject_above)


def test_grades_of_the_query_follow_toxicity_only(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = X.learn(docs, labels.where(~fold), queries.GRADE)
    assert len(model.thresholds) == 1
    out = X.predict_severity(docs, model, reject_above=0.5).join(
        labels.where(fold).select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    right = sum(r["truth"] for r in out if r["toxic"])
    assert right / sum(r["toxic"] for r in out) > 0.95
    assert right / sum(r["truth"] for r in out) > 0.83


def test_cut_is_chosen_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = X.learn(docs, labels.where(~fold), queries.GRADE)
    assert 0 < model.reject_above < X.REJECT_ABOVE
    out = X.predict_severity(docs, model).join(
        labels.where(fold).select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    right = sum(r["truth"] for r in out if r["toxic"])
    assert right / sum(r["toxic"] for r in out) >= X.PRECISION
    assert right / sum(r["truth"] for r in out) > 0.88


def test_cut_is_the_highest_that_keeps_to_recall_and_precision():
    dice = np.random.default_rng(5)
    for _ in range(60):
        toxic = dice.random(dice.integers(1, 60)) < 0.4
        p = np.round(np.clip(dice.normal(0.15 + 0.4 * toxic, 0.2), 0, 1), 2)
        cut, allowed = X.choose_cut(p, toxic), {}
        for c in {X.REJECT_ABOVE, *(v - 1e-6 for v in p if 0 < v <= X.REJECT_ABOVE)}:
            above, hits = (p > c).sum(), toxic[p > c].sum()
            if c == X.REJECT_ABOVE or hits >= X.PRECISION * above:
                allowed[c] = hits
        wanted = min(X.RECALL * toxic.sum(), max(allowed.values()))
        best = max(c for c, hits in allowed.items() if hits >= wanted)
        assert np.array_equal(p > cut, p > best) and cut <= X.REJECT_ABOVE


def test_features_do_not_depend_on_blocks(monkeypatch):
    text = "Idiot idiots, ÄRGER; über-all " * 40
    whole = X.Hasher().columns(text)
    monkeypatch.setattr(X, "BLOCK", 64)
    assert np.array_equal(X.Hasher().columns(text), whole)
    assert np.array_equal(X.Hasher().columns("IDIOT"), X.Hasher().columns("idiot"))
    assert len(X.Hasher().columns("")) == 0


def test_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(None, 1, 0), (3, None, None), (3, 1, 0)],
                                   "doc_id long, toxic int, quality int")
    model = X.learn(edge_docs, labels, GRADE)
    rows = X.predict_severity(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["severity"] <= 2 for r in rows)
    kept = X.drop_toxic(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == sum(not r["toxic"] for r in rows)
    assert X.predict_severity(no_docs, model).count() == 0 == X.drop_toxic(no_docs, model).count()
    unlearned = X.learn(edge_docs, labels.where("false"), GRADE)
    assert {r["severity"] for r in X.predict_severity(edge_docs, unlearned).collect()} == {0.0}
    assert X.drop_toxic(edge_docs, unlearned).count() == edge_docs.count()


def test_sample_is_bounded_by_its_features_too(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(100))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(X, "_held_out_cut", lambda columns, grades: 0.5)
    monkeypatch.setattr(X, "fit", lambda columns, grades: seen.append((columns, grades)) or X.OrdinalModel(np.zeros(1), np.zeros(0)))
    for features in (1 << 24, 2000, 1):
        X.learn(docs, labels, "toxic", features=features)
    sizes = [[len(c) for c in columns] for columns, _ in seen]
    assert len(sizes[0]) == 40 and sum(sizes[1]) <= 2000 < sum(sizes[0]) and len(sizes[2]) == 1
    for columns, grades in seen[1:]:  # the first documents in the hash's order
        assert all(np.array_equal(a, b) for a, b in zip(columns, seen[0][0]))
        assert list(grades) == list(seen[0][1][:len(grades)])
