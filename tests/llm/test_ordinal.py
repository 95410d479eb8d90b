import random

import numpy as np

from tessera.llm import ordinal, queries


def test_thresholds_and_weights_recovered():
    rng = np.random.default_rng(3)
    x = (rng.random((4000, 6)) < 0.4).astype(np.float32)
    w = np.array([3.0, 2.0, 0, 0, 0, 1.0])
    s = x @ w + rng.logistic(size=4000) * 0.3
    y = (s > 0.5).astype(int) + (s > 2.5).astype(int)  # between the scores that the flags can make
    got, theta = ordinal.fit_cumulative(x, y, 3)
    assert theta[0] < theta[1] and got[0] > got[1] > got[5] > got[2] and (got >= 0).all()
    tail = 1 / (1 + np.exp(-((x @ got)[:, None] - theta)))
    assert np.abs((tail > 0.5).sum(1) - y).mean() < 0.2


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    train = labels.where("doc_id % 2 = 0")
    model = ordinal.fit(docs, train)
    out = ordinal.grade(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    tp = (out.rejected & (out.toxic == 1)).sum()
    assert tp / (out.toxic == 1).sum() > 0.85
    assert (out.rejected & (out.toxic == 0)).sum() / (out.toxic == 0).sum() < 0.02
    assert ((out.severity >= 0) & (out.severity <= 2)).all() and set(out.grade) <= {0, 1, 2}


def test_corners(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["fine", "good", "day", "sun"]) for _ in range(8)) + (" vile" if i % 2 else ""), i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "vile", "x"), (7, None, "x"), (8, "", "x"), (1, "vile " * 30000, "x")], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (5, 9)], "doc_id long, toxic int")
    model = ordinal.fit(docs, labels)
    out = ordinal.grade(docs, model).collect()
    assert len(out) == 204 and out[0].__fields__ == ["doc_id", "text", "severity", "grade", "rejected"]
    assert all(r.rejected == ("vile" in (r.text or "")) for r in out)
    empty = ordinal.fit(docs, labels.limit(0))
    assert not ordinal.grade(docs, empty).where("rejected").count()
    assert ordinal.grade(docs.limit(0), model).count() == 0


def test_scorer_equals_the_features_of_the_text():
    rnd = random.Random(5)
    texts = [None, "", "Vile vile VILE", "1 2 3"] + [" ".join(rnd.choice(["vile", "vilest", "good", "sun", "x", "Ünschön"]) for _ in range(rnd.choice([1, 5, 400]))) for _ in range(60)]
    weights = {f: rnd.random() for t in texts for f in sorted(ordinal.text_features(t)) if rnd.random() < 0.6}
    score = ordinal.Model(weights, (1.0, 2.0)).scorer()
    for t in texts * 2:
        assert abs(score(t) - sum(weights.get(f, 0.0) for f in ordinal.text_features(t))) < 1e-9


def test_grades_come_from_labels(spark):
    rnd = random.Random(2)
    word = {0: "fine", 1: "vile", 2: "vile cruel"}
    rows = [(i, " ".join(rnd.choice(["good", "day", "sun"]) for _ in range(8)) + " " + word[i % 3], i % 3) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g > 0), int(g < 2)) for i, _, g in rows], "doc_id long, toxic int, quality int")
    model = ordinal.fit(docs, queries.graded(labels), label="grade")
    out = {r.doc_id: r for r in ordinal.grade(docs, model).collect()}
    assert all(out[i].grade == g and out[i].rejected == (g > 0) for i, _, g in rows)
    assert max(r.severity for r in out.values() if r.grade == 1) < min(r.severity for r in out.values() if r.grade == 2)
    two = ordinal.fit(docs, labels, label="toxic", grades=2)
    assert len(two.thetas) == 1 and {r.grade for r in ordinal.grade(docs, two).collect()} == {0, 1}
