import zlib

import numpy as np

from causeway.llm import toxicity


def auc(score, label):
    _, at, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]  # ties share their mean rank
    k = label.sum()
    return (rank[label == 1].sum() - k * (k + 1) / 2) / (k * (len(label) - k))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.join(labels, "doc_id"), model).where("held_out").join(labels, "doc_id").collect()
    y, p = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    assert len(rows) > 300 and auc(p, y) > 0.96
    found = p >= 0.5
    assert found[y == 1].mean() > 0.9 and found[y == 0].mean() < 0.015
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)


def test_labels_of_the_held_out_fold_do_not_matter(spark, docs, labels):
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert (a.bias, a.weights, a.prior) == (b.bias, b.weights, b.prior)


def test_odd_rows(docs, labels, odd, empty):
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}
    assert len(none) == 1
    assert toxicity.score(empty, model).collect() == []
    assert toxicity.reject(odd, model).columns == odd.columns
    nothing = toxicity.fit(empty, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(odd, nothing).collect()} == {0}


def test_non_negative_training_separates():
    rng = np.random.default_rng(3)
    rows, positive = [], []
    for k in range(600):
        toxic = k % 3 == 0 or k % 7 == 0
        rows.append(np.array([0, *rng.integers(2, 30, 5)] if toxic else rng.integers(2, 30, 5)))
        positive.append(k % 3 == 0)
    bias, w = toxicity.train(rows, np.array(positive), 30, prior=0.2)
    assert w[0] + bias > 0 and bias < 0 and abs(w[2:]).max() < w[0]
