"""Boosted trees against a plain version, both placements against each other, attributions against all subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspan.operators import attribution as A
from cohortspan.operators import boosting as B
from cohortspan.operators.evaluate import stratified_folds
from cohortspan.plans.queries import QUERIES

XS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        a, b, c = float(rng.integers(0, 40)), float(rng.integers(0, 2)), float(rng.normal())
        y = int(rng.random() < 1 / (1 + math.exp(2 - a / 12 - 2 * b)))
        rows.append((i, y, None if rng.random() < 0.2 else a, b, float("nan") if i % 17 == 0 else c))
    return spark.createDataFrame(rows, "id long, y int, a double, b double, c double").cache()


def folds_of(cohort, repeats=1):
    return B.prepare(stratified_folds(cohort, "y", "id", 3, repeats), XS, "y", ["id"])


def plain_tree(x, g, h, params, depth=0):
    """A nested tree by trying every value of every feature, nulls on either side."""
    G, H = g.sum(), h.sum()
    best = (-math.inf, None)
    if depth < params.depth:
        for f in range(x.shape[1]):
            null = np.isnan(x[:, f])
            for v in sorted(set(x[~null, f].tolist())):
                for null_left in (False, True):
                    left = np.where(null, null_left, x[:, f] <= v)
                    if left.all() or not left.any() or min(h[left].sum(), h[~left].sum()) < params.child_weight:
                        continue
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + params.l2) for s in (left, ~left)) - G**2 / (H + params.l2)
                    if gain > best[0] + 1e-12:
                        best = gain, left
    if best[1] is None or best[0] < max(params.gamma, B.LEAST_GAIN):
        return np.full(len(x), -params.rate * G / (H + params.l2))
    out = np.empty(len(x))
    for side in (best[1], ~best[1]):
        out[side] = plain_tree(x[side], g[side], h[side], params, depth + 1)
    return out


@pytest.mark.parametrize("params", [
    B.TreeParams(3, 3, 0.3, 1.0, 1.0, 0.0), B.TreeParams(2, 4, 0.1, 1.0, 1.0, 0.4), B.TreeParams(2, 3, 0.3, 1.0, 1.0, 0.0, child_weight=4.0)])
def test_trees_equal_a_search_of_all_splits(params):
    rng = np.random.default_rng(params.depth)
    x = np.column_stack([rng.integers(0, 30, 200), rng.integers(0, 2, 200), rng.integers(0, 9, 200)]).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    y = (rng.random(200) < np.where(np.isnan(x[:, 0]), 0.7, x[:, 0] / 40)).astype(float)
    cuts = [np.unique(x[~np.isnan(x[:, j]), j])[:-1] for j in range(3)]
    bins, margin = B.binned(x, cuts), np.zeros(200)
    forest = B.grow(bins, y, np.arange(200), cuts, params, 0)
    for _ in range(params.trees):
        p = 1 / (1 + np.exp(-margin))
        margin += plain_tree(x, p - y, p * (1 - p), params)
    assert np.allclose(forest.margin(bins), margin, atol=1e-9)


def test_both_placements_grow_the_same_models(cohort):
    folds = folds_of(cohort, 2)
    params = B.TreeParams(trees=9, depth=3, rate=0.3, column_sample=0.7, gamma=0.1)
    near, far = B.fit(folds, params), B.fit(folds, params, local_bytes=0)
    assert list(near) == list(far) == [(r, f) for r in range(2) for f in range(3)]
    one, two = ({(r.repeat, r.fold, r.id): r.score for r in B.cross_score(folds, f, ["id"]).collect()} for f in (near, far))
    assert len(one) == 600 and one.keys() == two.keys()
    assert max(abs(one[k] - two[k]) for k in one) < 1e-9
    assert [t.feature for t in near[1, 2].trees] == [t.feature for t in far[1, 2].trees]
    by_y = {r.id: r.y for r in cohort.collect()}
    held = [(s, by_y[k[2]]) for k, s in one.items()]
    assert np.mean([s for s, y in held if y]) > np.mean([s for s, y in held if not y]) + 0.1


def tree_value(tree, row, known, at=0):
    """Expected output of one tree when only ``known`` features are given."""
    f = tree.feature[at]
    if f < 0:
        return tree.value[at]
    left, right = tree.left[at], tree.left[at] + 1
    if f in known:
        goes_left = tree.null_left[at] if row[f] == B.MISSING else row[f] <= tree.cut[at]
        return tree_value(tree, row, known, left if goes_left else right)
    return (tree.cover[left] * tree_value(tree, row, known, left) + tree.cover[right] * tree_value(tree, row, known, right)) / tree.cover[at]


def test_attributions_are_shapley_values(cohort):
    folds = folds_of(cohort)
    forests = B.fit(folds, B.TreeParams(trees=4, depth=4, rate=0.3, column_sample=1.0, gamma=0.0))
    out = A.fold_attribution(folds, forests, ["id"], XS)
    assert out.columns == ["repeat", "fold", "id", "feature", "value", "attribution"] and out.count() == 900
    rows = {(r.id, r.feature): r for r in out.filter("id < 12").collect()}
    scores = {r.id: r.score for r in B.cross_score(folds, forests, ["id"]).collect()}
    table = {r.id: r for r in folds.table.filter("id < 12").collect()}
    for i, r in table.items():
        forest = forests[r.repeat, r.fold]
        x = np.array([[math.nan if v is None else v for v in r.x]], float)
        bins = forest.bins(x)[0]
        mine = [rows[i, f].attribution for f in XS]
        assert abs(A.base_value(forest) + sum(mine) - math.log(scores[i] / (1 - scores[i]))) < 1e-9
        assert [rows[i, f].value for f in XS] == list(r.x)
        for f in range(3):
            want, others = 0.0, [g for g in range(3) if g != f]
            for k in range(3):
                for subset in itertools.combinations(others, k):
                    w = math.factorial(k) * math.factorial(2 - k) / math.factorial(3)
                    want += w * sum(tree_value(t, bins, {*subset, f}) - tree_value(t, bins, set(subset)) for t in forest.trees)
            assert abs(mine[f] - want) < 1e-9
    summary = A.attribution_summary(out.filter("value IS NOT NULL")).collect()
    assert [r.mean_abs for r in summary] == sorted(r.mean_abs for r in summary)


def test_long_paths_are_additive():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 9))
    y = (x[:, :8].sum(1) + rng.normal(size=400) > 0).astype(float)
    cuts = [np.quantile(x[:, j], np.arange(1, 60) / 60) for j in range(9)]
    bins = B.binned(x, cuts)
    forest = B.grow(bins, y, np.arange(400), cuts, B.TreeParams(6, 8, 0.3, 0.9, 1.0, 0.0), 0)
    assert np.allclose(A.shapley(forest, bins).sum(1) + A.base_value(forest), forest.margin(bins))


def test_a_tree_is_explained_once_per_cell(monkeypatch):
    """Rows between the same cuts have the same attributions: work grows with the cells met, not with the rows."""
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 2, 3000), rng.integers(0, 2, 3000), rng.integers(0, 5, 3000)]).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    y = (rng.random(3000) < 0.2 + 0.1 * np.nan_to_num(x).sum(1)).astype(float)
    cuts = [np.array([0.0]), np.array([0.0]), np.arange(4.0)]
    bins = B.binned(x, cuts)
    forest = B.grow(bins, y, np.arange(3000), cuts, B.TreeParams(5, 6, 0.3, 0.9, 1.0, 0.0), 0)
    want = A._shapley_by_leaves(A._leaves(forest.trees), bins)
    rows, plain = [], A._shapley_by_leaves
    monkeypatch.setattr(A, "_shapley_by_leaves", lambda leaves, part: rows.append(len(part)) or plain(leaves, part))
    cells = A._cells(forest)
    for part in np.array_split(np.arange(3000), 4):
        assert np.allclose(A.shapley(forest, bins[part], cells), want[part], atol=1e-12)
    assert 0 < sum(rows) <= 5 * 3 * 3 * 6
    monkeypatch.setattr(A, "_KEPT_CELLS", 0)
    assert np.allclose(A.shapley(forest, bins), want, atol=1e-12)


def test_models_above_the_table_bound_but_each_below_grow_in_tasks(cohort, monkeypatch):
    """The bound holds per model: a table of many repeats went level by level, hundreds of jobs, though no model was large."""
    folds = folds_of(cohort, 2)
    monkeypatch.setattr(B, "_fit_by_levels", None)
    n = folds.table.count()
    assert B.fit(folds, B.TreeParams(trees=2, depth=3), local_bytes=n // 2 * (len(folds.cuts) + 24)).keys() == set(folds.splits)


def test_importances(spark, cohort):
    folds = folds_of(cohort)
    forests = B.fit(folds, B.TreeParams(trees=5, depth=3, rate=0.3, column_sample=1.0))
    table = B.fold_importance(spark, forests, XS)
    assert [round(r.s, 9) for r in table.groupBy("repeat", "fold").agg(F.sum("importance").alias("s")).collect()] == [1.0] * 3
    counts = {r.feature: r.splits for r in B.split_counts(spark, forests[0, 1], XS).collect()}
    assert sum(counts.values()) == sum(sum(f >= 0 for f in t.feature) for t in forests[0, 1].trees)


def test_rows_without_a_signal(spark):
    table = spark.createDataFrame([(i, 0, None, 1.0, float("nan")) for i in range(9)], "id long, y int, a double, b double, c double")
    folds = B.prepare(table.selectExpr("*", "0 AS repeat", "CAST(id % 3 AS INT) AS fold"), XS, "y", ["id"])
    for local in (B.LOCAL_BYTES, 0):
        forests = B.fit(folds, B.TreeParams(trees=2, depth=3), local_bytes=local)
        assert all(t.feature == [-1] for f in forests.values() for t in f.trees)
        for r in B.cross_score(folds, forests, ["id"]).collect():
            assert abs(math.log(r.score / (1 - r.score)) - sum(t.value[0] for t in forests[r.repeat, r.fold].trees)) < 1e-9
    assert A.fold_attribution(folds, forests, ["id"], XS).filter("attribution <> 0").count() == 0


class Fitted(Exception):
    pass


@pytest.mark.parametrize("name, want, models", [
    ("tree_holdout_2a", B.PLAIN_TREES, 1), ("tree_importance", B.PLAIN_TREES, 1), ("tree_recall_2b", B.PLAIN_TREES, 1),
    ("tree_cv_1", B.TreeParams(400, 8, 0.09, 0.9, 0.1, 0.4, 42), 25), ("attribution_summary_1", B.TreeParams(100, 8, 0.09), 25)])
def test_tree_queries_take_the_reference_settings(spark, monkeypatch, name, want, models):
    def fit(folds, params):
        assert params == want and len(folds.splits) == models
        raise Fitted

    monkeypatch.setattr(B, "fit", fit)
    with pytest.raises(Fitted):
        QUERIES[name](spark, "/root/testdata/sf0.01")
