"""Exact top-k against all products."""

import math
import random

import numpy as np
import pytest

from cohortspan.llm import top_k as K


def plain(rows, every=50, k=5):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(q)) for i, q in ok if i % every == 0}:
        found = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j) for j, p in ok if j != i and len(p) == len(q))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


def check(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS q", "2 AS score", "3 AS rank")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in K.top_k(frame).collect()) == plain(rows)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(K, "BUCKET_ROWS", 64)
    monkeypatch.setattr(K, "QUERY_ROWS", 3)
    check(spark, [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()])


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_lengths_clusters_and_ties(spark, monkeypatch, spread):
    monkeypatch.setattr(K, "BUCKET_ROWS", 100)
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(900)]
    rows += [(900 + i, rows[0][1]) for i in range(120)]
    check(spark, [(i, [x * rng.choice([1, 1, 1, 5]) for x in v] if i < 800 else v) for i, v in rows])


def test_coordinate_pruning_is_exact():
    rng = np.random.default_rng(5)
    matrix = np.floor(rng.normal(0, 40, (500, 6)) * rng.choice([1, 8], (500, 1))).astype(np.int64)
    queries = np.concatenate([matrix[:40], np.floor(rng.normal(0, 40, (40, 6))).astype(np.int64)])
    lengths, q_lengths = (np.sqrt((x.astype(float) ** 2).sum(1)) for x in (matrix, queries))
    ids, q_ids = np.arange(500), -1 - np.arange(80)
    scores = queries @ matrix.T
    for share in (0.0, 1.0):
        K.COORDINATE_SHARE, saved = share, K.COORDINATE_SHARE
        least = np.sort(scores, 1)[:, -5].astype(float)
        row, column, got = K.search_bucket(ids, matrix, lengths, q_ids, queries, q_lengths, least, 5)
        K.COORDINATE_SHARE = saved
        want = {(i, j) for i in range(80) for j in np.lexsort((ids, -scores[i]))[:5]}
        assert set(zip(row.tolist(), column.tolist(), strict=True)) == {(i, int(j)) for i, j in want}
        assert got == [int(scores[i, j]) for i, j in zip(row, column, strict=True)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    check(spark, [(0, [1.0, 2.0]), (50, None), (100, [nan, 1.0]), (150, [inf, 1.0]), (200, [None, 1.0]), (None, [1.0, 1.0]), (1, [0.0, 0.0]),
                  (2, [-1.0, -2.0]), (3, [1.0]), (250, []), (251, []), (300, [0.0, 0.0]), (4, [3.0, 3.0]), (4, [3.0, 3.0]), (-50, [2.0, 1.0]),
                  (350, [3e30, -3e30]), (400, [2e6, 1.0])][:15] + [(400, [2e6, 1.0])])
    assert K.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    huge = spark.createDataFrame([(0, [3e30, 1.0]), (1, [3e30, 2.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert K.top_k(huge).count() == 2
