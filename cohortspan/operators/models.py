"""Logistic classifiers on Spark's own learner, scored over folds, and tables of importances."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpointed

Fitter = Callable[[DataFrame], object]


# Decision cutoffs of the logistic and the three tree models.
LOGISTIC_CUTOFF = 0.0017
TREE_CUTOFFS = {"1": 0.00178, "2a": 0.132, "2b": 0.125}


def assemble(df: DataFrame, xs: Sequence[str], out: str = "x") -> DataFrame:
    return VectorAssembler(inputCols=list(xs), outputCol=out).transform(df)


def logistic(y: str, x: str = "x", c: float = 1.0) -> Fitter:
    """Ridge-penalised logistic model; ``c`` weighs the summed loss against the penalty, intercept free."""
    def fit(train: DataFrame):
        n = train.count()
        return LogisticRegression(featuresCol=x, labelCol=y, regParam=1.0 / (c * n), elasticNetParam=0.0,
                                  standardization=False, maxIter=100).fit(train)

    return fit


def score(model, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` and the probability of class 1."""
    return model.transform(df).select(*columns, vector_to_array("probability")[1].alias("score"))


def cross_fit(folded: DataFrame, fit: Fitter, threads: int = 4) -> dict[tuple[int, int], object]:
    """One model per (repeat, fold), trained on the other folds of the repeat.

    Each fit is a distributed job; a few run side by side so that small stages do not idle the cluster.
    """
    splits = [tuple(r) for r in folded.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()]

    def train(split):
        repeat, fold = split
        return split, fit(folded.filter((F.col("repeat") == repeat) & (F.col("fold") != fold)))

    with ThreadPool(threads) as pool:
        return dict(pool.map(inheritable_thread_target(folded.sparkSession)(train), splits))


def held_out(folded: DataFrame, split: tuple[int, int]) -> DataFrame:
    return folded.filter((F.col("repeat") == split[0]) & (F.col("fold") == split[1]))


def cross_score(folded: DataFrame, models: dict, columns: Sequence[str]) -> DataFrame:
    """Held-out probabilities of every fold as one long table."""
    parts = [score(model, held_out(folded, split), ["repeat", "fold", *columns]) for split, model in models.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def prepared_folds(folded: DataFrame, xs: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Materialised (repeat, fold, columns, x), in one folder per fold: a fit reads only its folds."""
    return checkpointed(assemble(folded, xs).select("repeat", "fold", *columns, "x"), ["repeat", "fold"])


def fold_importance_wide(long: DataFrame, k: int) -> DataFrame:
    """One column ``importance<i>`` per fold, i counting folds over repeats of ``k``."""
    return long.withColumn("_i", F.concat(F.lit("importance"), (F.col("repeat") * k + F.col("fold")).cast("string"))) \
        .groupBy("feature").pivot("_i").agg(F.first("importance"))


def mean_importance_top(long: DataFrame, k: int = 50) -> DataFrame:
    means = long.groupBy("feature").agg(F.avg("importance").alias("mean_importance"))
    return means.orderBy(F.desc("mean_importance"), "feature").limit(k)


def importance_top(table: DataFrame, k: int = 50) -> DataFrame:
    return table.orderBy(F.desc("importance"), "feature").limit(k)


def feature_list(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, n_known) in the order of ``names``, from one aggregate."""
    counts = df.agg(*[F.count(c).alias(c) for c in names])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_known")) for c in names]
    return counts.select(F.inline(F.array(*rows)))
