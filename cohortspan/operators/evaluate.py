"""Splits and classifier evaluation, from tables of (label, score) rows.

Everything starts from one row per distinct score (a map-side combined group-by), so ties cost
nothing and the curves follow from running totals over that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import clamp, hash_unit, indicator
from ..runtime import checkpointed
from .prefix import prefix_sum, with_totals

_DRAWS = 1 << 52


def holdout(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``. The draw depends on seed and key only, not on how the rows are laid out."""
    return df.withColumn("is_test", indicator(hash_unit(F.lit(seed), key) < int(share * _DRAWS)))


def stratified_folds(
    df: DataFrame, y: str, key: str, k: int = 5, repeats: int = 5, seed: int = 42, rows_per_part: int = 200_000
) -> DataFrame:
    """``df`` once per repeat with columns ``repeat`` and ``fold``; each fold keeps the class balance.

    Rows are dealt round-robin in hash order inside (repeat, label). Only ``key`` (unique) and label are
    copied per repeat and ranked; the other columns join the result. ``df`` is read twice, so hand in a
    written table.
    """
    drawn = df.select(key, y).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumns({
        "_draw": F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("repeat").cast("string"), F.col(key).cast("string"))),
        "_one": F.lit(1).cast("long"),
    })
    ranked = prefix_sum(drawn, ["repeat", y], [("_draw", True), (key, True)], {"_rank": "_one"}, rows_per_part)
    dealt = ranked.select(key, "repeat", ((F.col("_rank") - 1) % k).cast("int").alias("fold"))
    return df.join(dealt, key).select(*df.columns, "repeat", "fold")


def score_table(
    scored: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = (), rows_per_part: int = 200_000
) -> DataFrame:
    """Per distinct score: positives, negatives, their running counts from the top, and the totals."""
    groups = checkpointed(scored.groupBy(*by, F.col(score).alias("score")).agg(
        F.count(F.when(F.col(y) == 1, 1)).alias("pos"), F.count(F.when(F.col(y) == 0, 1)).alias("neg")
    ))
    running = prefix_sum(groups, list(by), [("score", False)], {"tp": "pos", "fp": "neg"}, rows_per_part, True)
    return with_totals(running, groups, by, {"n_pos": F.sum("pos"), "n_neg": F.sum("neg")})


def _ratio(a, b):
    return F.try_divide(a.cast("double"), b.cast("double"))


def _origin(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """The (0, 0) point before the first threshold, placed one above the highest score."""
    return table.groupBy(*by).agg((F.max("score") + 1).alias("threshold")).withColumns(
        {"fpr": F.lit(0.0), "tpr": F.lit(0.0)}
    )


def roc_curve(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(fpr, tpr, threshold) per distinct score, with the origin; from a ``score_table``."""
    points = table.select(
        *by, F.col("score").alias("threshold"),
        _ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), _ratio(F.col("tp"), F.col("n_pos")).alias("tpr"),
    )
    return points.unionByName(_origin(table, by))


def pr_curve(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(recall, precision, threshold) per distinct score, and the closing point (0, 1)."""
    tp, fp = F.col("tp"), F.col("fp")
    points = table.select(
        *by, F.col("score").alias("threshold"),
        _ratio(tp, F.col("n_pos")).alias("recall"), _ratio(tp, tp + fp).alias("precision"),
    )
    end = _origin(table, by).select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision")
    )
    return points.unionByName(end)


def roc_auc(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve; a tie between a positive and a negative counts one half."""
    below = F.col("n_neg") - F.col("fp") + F.col("neg") / F.lit(2.0)
    area = F.sum(F.col("pos").cast("double") * below)
    # The product of two counts leaves the long range at scale, hence two divisions.
    area = F.try_divide(F.try_divide(area, F.max("n_pos").cast("double")), F.max("n_neg").cast("double"))
    return table.groupBy(*by).agg(area.alias("auc"))


def threshold_sweep(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recall and F1 of ``score > threshold`` (strict) for every distinct score."""
    tp, fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    return table.select(
        *by, F.col("score").alias("threshold"),
        F.coalesce(_ratio(tp, F.col("n_pos")), F.lit(0.0)).alias("recall"),
        F.coalesce(_ratio(2 * tp, tp + fp + F.col("n_pos")), F.lit(0.0)).alias("f1"),
    )


def arg_max(df: DataFrame, metric: str, first_by: str) -> DataFrame:
    """The row with the largest metric, the smallest ``first_by`` on ties."""
    return df.orderBy(F.desc(metric), F.asc(first_by)).limit(1)


def best_threshold(sweep: DataFrame, metrics: Sequence[str] = ("recall", "f1")) -> DataFrame:
    """(metric, threshold, value) of the best threshold per metric, in one aggregate."""
    best = [F.max(F.struct(F.col(m), (-F.col("threshold")).alias("neg"))).alias(m) for m in metrics]
    rows = [
        F.struct(F.lit(m).alias("metric"), (-F.col(f"{m}.neg")).alias("threshold"), F.col(f"{m}.{m}").alias("value"))
        for m in metrics
    ]
    return sweep.agg(*best).select(F.inline(F.array(*rows)))


def confusion(scored: DataFrame, cutoff: float, y: str = "y", score: str = "score") -> DataFrame:
    """(actual, predicted, n) of ``score >= cutoff``, all four cells present."""
    guess = indicator(F.col(score) >= cutoff)
    cells = [(a, p) for a in (0, 1) for p in (0, 1)]
    counts = [F.count(F.when((F.col(y) == a) & (guess == p), 1)).alias(f"c{a}{p}") for a, p in cells]
    rows = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"c{a}{p}").alias("n")) for a, p in cells
    ]
    return scored.agg(*counts).select(F.inline(F.array(*rows)))


def recall_at(scored: DataFrame, cutoff: float, y: str = "y", score: str = "score") -> DataFrame:
    hit = F.count(F.when((F.col(y) == 1) & (F.col(score) >= cutoff), 1))
    return scored.agg(F.coalesce(_ratio(hit, F.count(F.when(F.col(y) == 1, 1))), F.lit(0.0)).alias("recall"))


def _first_step_at_or_after(x, steps: int):
    guess = F.ceil(x * steps).cast("int")
    return (
        F.when((guess > 0) & ((guess - 1) / F.lit(float(steps)) >= x), guess - 1)
        .when(guess / F.lit(float(steps)) < x, guess + 1)
        .otherwise(guess)
    )


def interpolated_roc(table: DataFrame, by: Sequence[str], points: int = 100) -> DataFrame:
    """Each curve's true-positive rate at ``points`` evenly spaced false-positive rates.

    An as-of join against the grid, without a join: curve points are reduced to the last one per
    grid cell and the first one per grid cell, at most ``points`` of each per curve, and carried
    along the grid from there.
    """
    steps = points - 1
    curve = roc_curve(table, by)
    at = _first_step_at_or_after(F.col("fpr"), steps)
    point = F.struct("fpr", "tpr")
    cells = curve.select(*by, point.alias("p"), at.alias("at"))
    left = cells.groupBy(*by, F.col("at").alias("step")).agg(F.max("p").alias("left"))
    right = cells.filter(F.col("at") > 0).groupBy(*by, (F.col("at") - 1).alias("step")).agg(F.min("p").alias("right"))
    grid = curve.select(*by).distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    on = [*by, "step"]
    forward = W.partitionBy(*by).orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    backward = W.partitionBy(*by).orderBy("step").rowsBetween(0, W.unboundedFollowing)
    x = F.col("step") / F.lit(float(steps))
    near = grid.join(left, on, "left").join(right, on, "left").select(
        *on, x.alias("x"), F.last("left", True).over(forward).alias("l"), F.first("right", True).over(backward).alias("r")
    )
    slope = F.try_divide(F.col("r.tpr") - F.col("l.tpr"), F.col("r.fpr") - F.col("l.fpr"))
    value = F.col("l.tpr") + F.coalesce(slope * (F.col("x") - F.col("l.fpr")), F.lit(0.0))
    return near.select(*on, F.col("x").alias("fpr"), F.when(F.col("step") == 0, 0.0).otherwise(value).alias("tpr"))


def mean_roc(table: DataFrame, by: Sequence[str], points: int = 100) -> DataFrame:
    """Mean curve over folds with a band of one standard deviation inside [0, 1], and its area."""
    last = points - 1
    curve = interpolated_roc(table, by, points).groupBy("step", "fpr").agg(
        F.avg("tpr").alias("mean_tpr"), F.stddev_pop("tpr").alias("std_tpr")
    ).withColumn("mean_tpr", F.when(F.col("step") == last, 1.0).otherwise(F.col("mean_tpr")))
    # Windows over the grid only.
    along = W.orderBy("step")
    area = (F.col("fpr") - F.lag("fpr").over(along)) * (F.col("mean_tpr") + F.lag("mean_tpr").over(along)) / 2
    curve = curve.withColumn("_area", area)
    return curve.select(
        "step", "fpr", "mean_tpr", "std_tpr",
        clamp(F.col("mean_tpr") - F.col("std_tpr"), 0.0, 1.0).alias("lower"),
        clamp(F.col("mean_tpr") + F.col("std_tpr"), 0.0, 1.0).alias("upper"),
        F.sum("_area").over(W.partitionBy()).alias("mean_auc"),
    )


def auc_stats(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, population standard deviation, standard error and half 95% interval of the folds' areas."""
    stats = roc_auc(table, by).agg(
        F.count("*").alias("folds"), F.avg("auc").alias("avg_auc"), F.stddev_pop("auc").alias("std_auc")
    )
    error = F.col("std_auc") / F.sqrt(F.col("folds").cast("double"))
    return stats.withColumns({"std_error": error, "half_interval": 1.96 * error})
