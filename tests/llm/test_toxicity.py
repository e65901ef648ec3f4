import numpy as np
from pyspark.sql import functions as F

from edgeloom.llm import toxicity as tox


def test_features():
    assert set(tox.features_of("¡Idiot!!".encode())) == {"idiot", "^idi", "^idio", "^idiot"}
    assert tox.features_of(b"12 -- 3") == [] and set(tox.features_of("été's".encode())) == {"été", "^été", "s"}


def test_ordered_thresholds_recover_grades():
    rng = np.random.default_rng(0)
    n, f = 4000, 12
    x = rng.random((n, f)) < 0.3
    w = np.array([3, 2, 1.5, -2, 0, 0, 0, 0, 0, 0, 0, 0])
    latent = x @ w + rng.logistic(size=n)
    grades = np.digitize(latent, [0.5, 2.0, 4.0])
    row, column = np.nonzero(x)
    got, thresholds = tox.fit(row, column, grades, f, 4)
    assert (np.diff(thresholds) > 0).all()
    assert np.abs(got - w).max() < 0.5 and np.abs(thresholds - [0.5, 2, 4]).max() < 0.5
    shares = tox.grade_shares(x @ got, thresholds)
    assert np.allclose(shares.sum(axis=1), 1) and (shares >= 0).all()
    severity = shares @ np.arange(4)
    assert np.corrcoef(severity, grades)[0, 1] > 0.6


def test_gradient_is_that_of_the_likelihood():
    # One feature and two grades: the weight that the closed form of the log odds gives.
    grades = np.array([0] * 60 + [1] * 40 + [0] * 20 + [1] * 80)
    row = np.arange(100, 200)
    w, thresholds = tox.fit(row, np.zeros(100, int), grades, 1, 2, steps=2000)
    assert abs(thresholds[0] - np.log(60 / 40)) < 0.05 and abs(w[0] - np.log(80 / 20) - np.log(60 / 40)) < 0.15


def test_held_out_accuracy_and_odd_rows(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    learn, hold = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    got = tox.toxicity(docs, learn).join(hold.select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    hit = np.array([r.toxic for r in got])
    label = np.array([r.label == 1 for r in got])
    assert hit[label].mean() > 0.85 and hit[~label].mean() < 0.01
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "x " * 200_000, 0.5), (3, "x " * 200_000, 0.5), (None, "ab", 0.5)], "doc_id long, text string, severity double")
    assert tox.toxicity(odd, labels).count() == 5
    assert tox.toxicity(odd.limit(0), labels).count() == 0
    assert {(r.grade, r.toxic) for r in tox.toxicity(odd, labels.limit(0)).collect()} == {(0, False)}


def test_severity_against_plain_sums(spark):
    import math
    import re

    import xxhash

    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    long = "x" * 100_000
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, long), (-2, long + "y"), (-3, None)], "doc_id long, text string"))
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).unionByName(spark.createDataFrame([(-1, 2), (-3, 1), (-9, 1), (None, 1), (-2, None)], "doc_id long, toxic int"))
    w, thresholds = tox.train(docs, labels)
    assert len(thresholds) == 2 and thresholds[0] < thresholds[1]
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = set()
    for r in tox.toxicity(docs, labels).collect():
        words = set(re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower()))
        held = words | {"^" + x[:k] for x in words for k in range(3, 7) if len(x) >= k}
        score = math.fsum(w[n] for n in {xxhash.xxh3_64_intdigest(f.encode()) >> 44 for f in held})
        below = [1 / (1 + math.exp(-max(-700, min(700, t - score)))) for t in thresholds]
        shares = [below[0], below[1] - below[0], 1 - below[1]]
        assert abs(r.severity - (shares[1] + 2 * shares[2])) < 1e-6 and r.grade == shares.index(max(shares)) and r.toxic == (r.severity >= tox.LEAST_SEVERITY)
        seen.add(r.doc_id)
    assert seen == set(texts)
    # A word counts to its last letter.
    scores = {r.doc_id: r.severity for r in tox.toxicity(docs, labels).filter("doc_id IN (-1, -2)").collect()}
    assert scores[-1] > scores[-2]


def test_what_tells_nothing_weighs_nothing():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 2, 2000)
    first, noise = np.nonzero(grades)[0], rng.integers(0, 2000, 1500)
    row, column = np.concatenate([first, noise]), np.concatenate([np.zeros(len(first), int), rng.integers(1, 400, 1500)])
    g = tox.telling(row, column, grades, 400)
    assert g[0] > 2000 and np.median(g[1:]) < 3
    # Of one feature, against the formula for a two by two table.
    has = np.bincount(row[column == 7], minlength=2000) > 0
    counts = np.array([[np.sum(has & (grades == k)), np.sum(~has & (grades == k))] for k in (0, 1)], float)
    expected = counts.sum(1, keepdims=True) * counts.sum(0, keepdims=True) / 2000
    assert g[7] >= 0 and (len(row[column == 7]) != has.sum() or np.isclose(g[7], 2 * np.sum(np.where(counts > 0, counts * np.log(np.maximum(counts, 1e-9) / expected), 0))))
