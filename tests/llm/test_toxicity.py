"""Toxicity: accuracy on held-out labels, what scores may depend on, odd rows."""

import zlib

import numpy as np

from cohortspan.llm import boosting, toxicity

FOLDER = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id", "left").toPandas()
    assert len(rows) == docs.count() and rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.5)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(rows["doc_id"], rows["held_out"], strict=True))
    held = rows[rows["held_out"] & rows["toxic"].notna()]
    y, p = held["toxic"].to_numpy(float), held["predicted"].to_numpy()
    print("auc", auc(held["score"].to_numpy(), y), "recall", p[y == 1].mean(), "false", p[y == 0].mean())
    assert auc(held["score"].to_numpy(), y) > 0.9 and p[y == 1].mean() > 0.8 and p[y == 0].mean() < 0.01


def test_held_out_labels_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.fold() == 0, 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    other = docs.selectExpr("doc_id", "text", "'z' AS lang", "'s' AS source", "1 AS score")
    a = toxicity.score(docs, labels).orderBy("doc_id").collect()
    b = toxicity.score(other, flipped).orderBy("doc_id").collect()
    assert a == b


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, "you idiot"), (3, ""), (3, "fine day"), (4, "x " * 100_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(docs.limit(0), none).count() == 0
    some = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    assert toxicity.score(docs, some).count() == 5
    assert toxicity.clean_documents(docs, none).count() == 5


def test_sample_is_bounded_by_rows_not_ids(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(4000)] + [(2, "copy")] * 3000 + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity._sample(docs, labels, 10_000).count() == 4002
    few = toxicity._sample(docs, labels, 500).collect()
    assert 350 < len(few) < 650 and len({(r.doc_id, r.text) for r in few}) == len(few) and {r.y for r in few if r.doc_id == 1} == {1}


def test_isotonic_is_the_pooled_mean():
    rng = np.random.default_rng(1)
    s = rng.random(300)
    y = (rng.random(300) < s).astype(float)
    at, value = boosting.isotonic(s, y)
    assert (np.diff(value) > 0).all() and (np.diff(at) > 0).all()
    pooled = np.interp(s, at, value)
    assert all(abs(y[s <= t].mean() - pooled[s <= t].mean()) < 0.05 for t in np.quantile(s, [0.5, 0.8, 1.0]))
