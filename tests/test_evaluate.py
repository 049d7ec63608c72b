import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspan.operators import evaluate as E
from cohortspan.operators.prefix import prefix_sum


def scored_rows(n=400, seed=1, digits=2, folds=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        rows.append((i, i % folds, y, round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2))), digits)))
    return rows


@pytest.mark.parametrize("rows_per_part", [200000, 50])
def test_prefix_sum_matches_plain_loop(spark, rows_per_part):
    rows = [(i, 0 if i < 200 else i % 4, random.Random(i).random(), i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g int, o double, v long")
    out = prefix_sum(df, ["g"], [("o", False), ("id", True)], {"s": "v"}, rows_per_part)
    want, run = {}, {}
    for i, g, o, v in sorted(rows, key=lambda r: (r[1], -r[2], r[0])):
        run[g] = run.get(g, 0) + v
        want[i] = run[g]
    assert {r.id: r.s for r in out.collect()} == want


@pytest.mark.parametrize("rows_per_part", [200000, 20])
def test_auc_and_sweep_by_brute_force(spark, rows_per_part):
    rows = scored_rows()
    df = spark.createDataFrame(rows, "id long, fold int, y int, score double")
    table = E.score_table(df, rows_per_part=rows_per_part).cache()
    pos = [r[3] for r in rows if r[2]]
    neg = [r[3] for r in rows if not r[2]]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert abs(E.roc_auc(table).first().auc - want) < 1e-12
    for r in E.threshold_sweep(table).collect():
        tp = sum(p > r.threshold for p in pos)
        fp = sum(q > r.threshold for q in neg)
        assert abs(r.recall - tp / len(pos)) < 1e-12
        assert abs(r.f1 - (2 * tp / (tp + fp + len(pos)))) < 1e-12
    best = {r.metric: r for r in E.best_threshold(E.threshold_sweep(table)).collect()}
    sweep = sorted(E.threshold_sweep(table).collect(), key=lambda r: (-r.f1, r.threshold))
    assert best["f1"].threshold == sweep[0].threshold
    assert E.arg_max(E.threshold_sweep(table), "f1", "threshold").first().threshold == sweep[0].threshold


def test_interpolation_equals_numpy(spark):
    rows = scored_rows(n=600, folds=3)
    df = spark.createDataFrame(rows, "id long, fold int, y int, score double")
    table = E.score_table(df, by=["fold"]).cache()
    grid = np.linspace(0, 1, 100)
    tprs = []
    for fold in range(3):
        pts = sorted((r.fpr, r.tpr) for r in E.roc_curve(table, ["fold"]).filter(F.col("fold") == fold).collect())
        y = np.interp(grid, [p[0] for p in pts], [p[1] for p in pts])
        y[0] = 0.0
        tprs.append(y)
        got = E.interpolated_roc(table, ["fold"]).filter(F.col("fold") == fold).orderBy("step").collect()
        assert np.allclose([r.tpr for r in got], y, atol=1e-12)
    mean = np.mean(tprs, axis=0)
    mean[-1] = 1.0
    got = E.mean_roc(table, ["fold"]).orderBy("step").collect()
    assert np.allclose([r.mean_tpr for r in got], mean, atol=1e-12)
    assert abs(got[0].mean_auc - np.trapezoid(mean, grid)) < 1e-12


def test_single_tied_score(spark):
    df = spark.createDataFrame([(i, 0, i % 2, 0.5) for i in range(10)], "id long, fold int, y int, score double")
    assert E.roc_auc(E.score_table(df)).first().auc == 0.5


@pytest.mark.parametrize("rows_per_part", [200000, 100])
def test_folds_partition_rows_and_keep_balance(spark, rows_per_part):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(203)], "id long, y int")
    out = E.stratified_folds(df, "y", "id", 5, 2, 42, rows_per_part).collect()
    for repeat in range(2):
        mine = [r for r in out if r["repeat"] == repeat]
        assert sorted(r.id for r in mine) == list(range(203))
        for y in (0, 1):
            sizes = [sum(r.fold == f and r.y == y for r in mine) for f in range(5)]
            assert max(sizes) - min(sizes) <= 1
