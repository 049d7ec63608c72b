"""Additive (Shapley) attribution of model output to features, and its summaries."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import MISSING, Folds, Forest, Tree, held_rows, matrix

_LONG = "feature string, value double, attribution double"
_KEPT_CELLS = 4096  # of a tree, whose attributions are kept from batch to batch


def linear_attribution(coefficients: Sequence[float], df: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Coefficient times distance from the mean, per row and feature: columns only, no Python."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in xs]).alias("means")).scalar()
    parts = [
        F.struct(
            F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
            (F.lit(float(w)) * (F.col(c) - F.col("_means").getField(c))).alias("attribution"),
        )
        for c, w in zip(xs, coefficients, strict=True)
    ]
    return df.withColumn("_means", means).select(*keys, F.inline(F.array(*parts)))


def _leaves(trees: Sequence[Tree]) -> dict[int, tuple[np.ndarray, ...]]:
    """Leaves by the number of distinct features on their path: value, and per feature its number, the bins a row must
    lie in (above low, up to high), whether a null goes this way, and the share of rows that would follow the path if
    the feature were unknown."""
    by_size = defaultdict(list)
    for tree in trees:
        stack = [(0, {})]
        while stack:
            at, path = stack.pop()
            f = tree.feature[at]
            if f < 0:
                by_size[len(path)].append((tree.value[at], path))
                continue
            low, high, null, share = path.get(f, (-1, MISSING - 1, True, 1.0))
            for child, (down, up), takes in (
                    (tree.left[at], (low, min(high, tree.cut[at])), tree.null_left[at]),
                    (tree.left[at] + 1, (max(low, tree.cut[at]), high), not tree.null_left[at])):
                stack.append((child, {**path, f: (down, up, null and takes, share * tree.cover[child] / tree.cover[at])}))
    out = {}
    for size, leaves in by_size.items():
        cells = np.array([[(f, *p[f]) for f in sorted(p)] for _, p in leaves], float).reshape(len(leaves), size, 5)
        out[size] = (np.array([v for v, _ in leaves]), cells[..., 0].astype(int), cells[..., 1], cells[..., 2], cells[..., 3] > 0, cells[..., 4])
    return out


def base_value(forest: Forest) -> float:
    """Expected margin of the ensemble over its training rows' cover."""
    return float(sum((leaves[0] * leaves[5].prod(1)).sum() for leaves in _leaves(forest.trees).values()))


def _shapley_by_leaves(by_size: Mapping[int, tuple[np.ndarray, ...]], bins: np.ndarray, block: int = 128) -> np.ndarray:
    """Attribution of the margin to every feature, row by row.

    A leaf is worth its value times the product, over the features of its path, of "known and fitting" or of the share.
    Weighing all subsets of known features is the integral over t from 0 to 1 of that product with t times fitting plus
    (1 - t) times share as factors, a polynomial: Gauss points give it exactly, and dividing one factor out of the
    product gives each feature's part.
    """
    phi = np.zeros(bins.shape)
    for size, leaves in by_size.items():
        if not size:
            continue
        points, weights = np.polynomial.legendre.leggauss((size + 1) // 2)
        for at in range(0, len(leaves[0]), block):
            value, feature, low, high, null, share = (part[at:at + block] for part in leaves)
            b = bins[:, feature]
            fits = np.where(b == MISSING, null, (b > low) & (b <= high)).astype(float)
            others = np.zeros(fits.shape)
            for t, w in zip((points + 1) / 2, weights / 2, strict=True):
                factors = fits * t + share * (1 - t)
                others += w * factors.prod(2, keepdims=True) / factors
            parts = value[:, None] * (fits - share) * others
            for j in range(size):
                phi += parts[:, :, j] @ (feature[:, j, None] == np.arange(bins.shape[1])).astype(float)
    return phi


class _Cells:
    """One tree's attributions. They only depend on where a row lies between the tree's own cuts, so each such cell is
    worked out once, from the first row met in it; the cells of a tree with few of them are remembered."""

    def __init__(self, tree: Tree):
        self.tree, cuts = tree, defaultdict(set)
        for f, cut in zip(tree.feature, tree.cut, strict=True):
            if f >= 0:
                cuts[f].add(cut)
        self.features = np.array(sorted(cuts), int)
        self.size, self.places, self.leaves = 1, [], None
        for f in self.features.tolist():
            place = np.searchsorted(np.array(sorted(cuts[f])), np.arange(MISSING + 1))
            place[MISSING] = len(cuts[f]) + 1
            self.places.append((f, place * self.size if self.size < 1 << 50 else None))
            self.size *= len(cuts[f]) + 2
        self.known = np.full(self.size, -1, np.int32) if self.size <= _KEPT_CELLS else None
        self.phi = np.empty((0, len(self.features)))

    def _work_out(self, bins: np.ndarray) -> np.ndarray:
        if self.leaves is None:
            self.leaves = _leaves([self.tree])
        return _shapley_by_leaves(self.leaves, bins)[:, self.features]

    def add_to(self, phi: np.ndarray, bins: np.ndarray) -> None:
        if not len(self.features):
            return
        if self.size >= 1 << 50:
            phi[:, self.features] += self._work_out(bins)
            return
        cell = sum(place[bins[:, f]] for f, place in self.places)
        if self.known is None:
            _, first, inverse = np.unique(cell, return_index=True, return_inverse=True)
            phi[:, self.features] += self._work_out(bins[first])[inverse]
            return
        at = self.known[cell]
        if (at < 0).any():
            new, first = np.unique(cell[at < 0], return_index=True)
            self.known[new] = len(self.phi) + np.arange(len(new))
            self.phi = np.concatenate([self.phi, self._work_out(bins[at < 0][first])])
            at = self.known[cell]
        phi[:, self.features] += self.phi[at]


def _cells(forest: Forest) -> list[_Cells]:
    return [_Cells(tree) for tree in forest.trees]


def shapley(forest: Forest, bins: np.ndarray, cells: Sequence[_Cells] | None = None) -> np.ndarray:
    """Attribution of the margin to every feature, row by row: the sum of its trees'. ``cells`` carries on earlier work."""
    phi = np.zeros(bins.shape)
    for tree in _cells(forest) if cells is None else cells:
        tree.add_to(phi, bins)
    return phi


def fold_attribution(folds: Folds, forests: Mapping[tuple[int, int], Forest], keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(repeat, fold, keys, feature, value, attribution) of every held-out row by the model that did not see it.

    On the log-odds scale: a row's attributions plus ``base_value`` give the model's log-odds for it. One scan; the
    models travel to the tasks, the rows stay where they are.
    """
    types = dict(folds.table.dtypes)
    columns = ["repeat", "fold", *keys]
    shared = folds.table.sparkSession.sparkContext.broadcast(dict(forests))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {}
        for batch in batches:
            for split, rows in held_rows(batch, shared.value):
                if split not in cells:
                    cells[split] = _cells(shared.value[split])
                for start in range(0, len(rows), 1024):
                    part = batch.take(pa.array(rows[start:start + 1024]))
                    x = matrix(part.column(part.num_columns - 1), part.num_rows)
                    phi = shapley(shared.value[split], shared.value[split].bins(x), cells[split])
                    again = pa.array(np.repeat(np.arange(len(x)), len(names)))
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(again) for c in part.columns[:-1]), pa.array(list(names) * len(x), pa.string()),
                         pa.array(x.ravel(), from_pandas=True), pa.array(phi.ravel())], names=[*columns, "feature", "value", "attribution"])

    return folds.table.select(*columns, "x").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in columns) + ", " + _LONG)


def attribution_summary(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution and direction per feature, smallest first.

    The direction is the sign of the correlation with the feature's value; a constant feature has
    no correlation, which counts as zero and therefore as negative.
    """
    a, v = F.col("attribution"), F.col("value")
    corr = F.try_divide(F.covar_pop(a, v), F.stddev_pop(a) * F.stddev_pop(v))
    return (
        attributions.groupBy("feature")
        .agg(F.avg(F.abs(a)).alias("mean_abs"), F.coalesce(corr, F.lit(0.0)).alias("corr"))
        .withColumn("direction", F.when(F.col("corr") > 0, "positive").otherwise("negative"))
        .orderBy("mean_abs", "feature")
    )


def attribution_quantiles(
    attributions: DataFrame, k: int = 50, quantiles: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0), accuracy: int = 10000
) -> DataFrame:
    """Quantiles of attribution and value for the ``k`` features with the largest mean attribution."""
    qs = F.lit([float(q) for q in quantiles])
    per_feature = attributions.groupBy("feature").agg(
        F.avg(F.abs("attribution")).alias("mean_abs"),
        F.percentile_approx("attribution", qs, accuracy).alias("a"),
        F.percentile_approx("value", qs, accuracy).alias("v"),
    ).orderBy(F.desc("mean_abs"), "feature").limit(k)
    return per_feature.select("feature", "mean_abs", F.inline(F.arrays_zip(qs.alias("quantile"), F.col("a").alias("attribution"), F.col("v").alias("value"))))


def attribution_scatter(
    attributions: DataFrame, k: int = 50, bins: int = 8, quantiles: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0), accuracy: int = 10000
) -> DataFrame:
    """Attribution against value, for the ``k`` features with the largest mean attribution.

    A feature's values are cut at their own quantiles into at most ``bins`` bins of about equal depth; equal values
    stay together. Per bin: number of rows, least and greatest value, and quantiles of the attributions of just these
    rows. Rows without a value are a bin of their own, with null limits. Every aggregate combines per partition, so
    a feature's rows never meet in one task; what is broadcast is one row per feature reported.
    """
    cuts = F.percentile_approx("value", F.lit([i / bins for i in range(1, bins)]), accuracy)
    features = attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"), cuts.alias("cuts")).orderBy(
        F.desc("mean_abs"), "feature").limit(k)
    binned = attributions.join(F.broadcast(features), "feature").withColumn(
        "bin", F.when(F.col("value").isNotNull(), F.size(F.filter("cuts", lambda cut: cut < F.col("value")))))
    qs = F.lit([float(q) for q in quantiles])
    return binned.groupBy("feature", "bin").agg(
        F.first("mean_abs").alias("mean_abs"), F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.percentile_approx("attribution", qs, accuracy).alias("a"),
    ).select("feature", "mean_abs", "bin", "n", "low", "high", F.inline(F.arrays_zip(qs.alias("quantile"), F.col("a").alias("attribution"))))
