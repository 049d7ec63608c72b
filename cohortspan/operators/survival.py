"""Kaplan-Meier curves and Cox regression.

Both reduce the cohort to one row per distinct duration first. For Kaplan-Meier durations are whole days, so that
table has at most as many rows per arm as the follow-up has days, and only there do ordered windows
run. Cox regression takes any durations: many distinct ones are summed up in range partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import checkpointed
from ..sources.schemas import COX_TABLE
from .prefix import prefix_sum

Z95 = 1.959963984540054
TIE_PARTS = 32  # tasks over which the times with deaths are dealt
TIMES = 200_000  # more distinct times are summed up in parts
SHORT_TIE = 1024  # deaths at one time that are added up one by one


def km_curve(df: DataFrame, time: str, event: str, by: str) -> DataFrame:
    """(arm, duration, died, at_risk, survival) for every distinct duration per arm."""
    per_day = df.groupBy(by, time).agg(
        F.count(F.when(F.col(event) == 1, 1)).alias("died"), F.count("*").alias("_n")
    )
    later = W.partitionBy(by).orderBy(F.desc(time))
    so_far = W.partitionBy(by).orderBy(time)
    table = per_day.withColumn("at_risk", F.sum("_n").over(later)).drop("_n")
    died, at_risk = F.col("died").cast("double"), F.col("at_risk").cast("double")
    # log(0) is null and a null is skipped by sum, so a day on which all die needs its own mark.
    step = F.when(F.col("died") < F.col("at_risk"), F.log1p(-F.try_divide(died, at_risk)))
    extinct = F.max(F.when(F.col("died") == F.col("at_risk"), 1).otherwise(0)).over(so_far)
    product = F.exp(F.coalesce(F.sum(step).over(so_far), F.lit(0.0)))
    return table.withColumn("survival", F.when(extinct == 1, F.lit(0.0)).otherwise(product))


def km_band(curve: DataFrame, by: str, time: str = "duration", z: float = Z95) -> DataFrame:
    """Add the log-log band with Greenwood's variance; null where survival is 0 or 1."""
    so_far = W.partitionBy(by).orderBy(time)
    died, at_risk = F.col("died").cast("double"), F.col("at_risk").cast("double")
    term = F.when(F.col("died") < F.col("at_risk"), died / (at_risk * (at_risk - died)))
    log_s = F.log("survival")
    half = F.lit(z) * F.sqrt(F.sum(term).over(so_far)) / F.abs(log_s)
    inside = (F.col("survival") > 0) & (F.col("survival") < 1)

    def bound(sign: int):
        return F.when(inside, F.exp(-F.exp(F.log(-log_s) + F.lit(float(sign)) * half)))

    return curve.withColumns({"lower95": bound(1), "upper95": bound(-1)})


def _terms(share: np.ndarray, s0: np.ndarray, e0: np.ndarray) -> np.ndarray:
    den = s0 - share * e0
    inv = 1.0 / den
    return np.array([np.log(den), inv, share * inv, inv * inv, share * inv * inv, share * share * inv * inv])


def _long_tie(s0: float, e0: float, d: float) -> np.ndarray:
    """The six sums over l = 0..d-1 for many deaths at a time: blocks that halve the way to the pole at l = d * s0 / e0.

    A short block is added up. A long one is the integral between the midpoints before and after it, by Gauss points,
    with the midpoint rule's first correction; the pole is at least a block's length behind its end, so both are as
    good as exact. No block is a difference of large numbers, however few of those at risk die.
    """
    points, weights = np.polynomial.legendre.leggauss(12)
    total, at = np.zeros(6), 0.0
    while at < d:
        n = min(d - at, max(float(SHORT_TIE), np.floor((d - at) / 2)))
        if n <= SHORT_TIE:
            total += _terms((at + np.arange(n)) / d, s0, e0).sum(1)
        else:
            total += n / 2 * (_terms((at - 0.5 + n * (points + 1) / 2) / d, s0, e0) @ weights)
            first, second, third, fourth = _terms(np.array([at - 1, at, at + n - 1, at + n]) / d, s0, e0).T
            total -= ((fourth - third) - (second - first)) / 24
        at += n
    return total


def _tie_sums(s0: pd.Series, e0: pd.Series, deaths: pd.Series) -> pd.DataFrame:
    """Efron's sums over l = 0..d-1 of f = 1 / (s0 - l/d * e0), with d deaths at a time.

    Times with few deaths go through together, one l at a time; a time with d deaths takes about log2(d) blocks.
    """
    s, e, d = (column.to_numpy(dtype=float) for column in (s0, e0, deaths))
    out = np.zeros((len(s), 6))
    order = np.argsort(d, kind="stable")
    few = order[: np.searchsorted(d[order], SHORT_TIE, "right")]
    first = 0
    for done in range(int(d[few[-1]]) if len(few) else 0):
        first += np.searchsorted(d[few[first:]], done, "right")
        rows = few[first:]
        out[rows] += _terms(done / d[rows], s[rows], e[rows]).T
    for row in order[len(few):]:
        out[row] = _long_tie(s[row], e[row], d[row])
    return pd.DataFrame(out, columns=["log_den", "a0", "a1", "b0", "b1", "b2"])


_TIE_SUMS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("log_den", "a0", "a1", "b0", "b1", "b2")])
tie_sums = F.pandas_udf(_tie_sums, _TIE_SUMS)


def _cox_sums(patterns: DataFrame, time: str, event: str, xs: Sequence[str], centre, many: bool, beta):
    """Partial log-likelihood, gradient and information at ``beta``: one grouped pass, p + p*p numbers back."""
    p = len(xs)
    cells = [(i, j) for i in range(p) for j in range(i + 1)]
    x = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(xs, centre)]
    eta = F.lit(0.0)
    for xi, b in zip(x, beta):
        eta = eta + xi * F.lit(float(b))
    src = patterns.select(
        F.col(time).alias("t"), (F.col(event) == 1).alias("e"), F.col("n").cast("double").alias("n"),
        *[xi.alias(f"x{i}") for i, xi in enumerate(x)], (F.col("n") * F.exp(eta)).alias("w"), eta.alias("eta"),
    )
    died = lambda c: F.sum(F.when(F.col("e"), c).otherwise(0.0))
    w = F.col("w")
    xi = lambda i: F.col(f"x{i}")
    per_day = src.groupBy("t").agg(
        F.sum(w).alias("s0"),
        *[F.sum(w * xi(i)).alias(f"s1_{i}") for i in range(p)],
        *[F.sum(w * xi(i) * xi(j)).alias(f"s2_{i}_{j}") for i, j in cells],
        died(F.col("n")).alias("d"), died(w).alias("e0"), died(F.col("n") * F.col("eta")).alias("eta_sum"),
        *[died(F.col("n") * xi(i)).alias(f"x_{i}") for i in range(p)],
        *[died(w * xi(i)).alias(f"e1_{i}") for i in range(p)],
        *[died(w * xi(i) * xi(j)).alias(f"e2_{i}_{j}") for i, j in cells],
    )
    risk_columns = ["s0", *[f"s1_{i}" for i in range(p)], *[f"s2_{i}_{j}" for i, j in cells]]
    if many:
        at_risk = prefix_sum(per_day, [], [("t", False)], {c: c for c in risk_columns}, TIMES).filter("d > 0")
    else:  # at most TIMES rows in this window; they are dealt out again so that their tie sums run side by side
        later = W.orderBy(F.desc("t"))
        at_risk = per_day.withColumns({c: F.sum(c).over(later) for c in risk_columns}).filter("d > 0")
        at_risk = at_risk.repartition(TIE_PARTS, "t")
    at_risk = at_risk.withColumn("k", tie_sums("s0", "e0", "d"))
    k = lambda name: F.col(f"k.{name}")
    col = F.col
    log_lik = F.sum(col("eta_sum") - k("log_den"))
    gradient = [F.sum(col(f"x_{i}") - (col(f"s1_{i}") * k("a0") - col(f"e1_{i}") * k("a1"))) for i in range(p)]
    information = [
        F.sum(
            col(f"s2_{i}_{j}") * k("a0") - col(f"e2_{i}_{j}") * k("a1")
            - (
                col(f"s1_{i}") * col(f"s1_{j}") * k("b0")
                - (col(f"s1_{i}") * col(f"e1_{j}") + col(f"e1_{i}") * col(f"s1_{j}")) * k("b1")
                + col(f"e1_{i}") * col(f"e1_{j}") * k("b2")
            )
        )
        for i, j in cells
    ]
    row = at_risk.agg(log_lik.alias("ll"), *[g.alias(f"g{i}") for i, g in enumerate(gradient)],
                      *[h.alias(f"h{n}") for n, h in enumerate(information)]).first()
    info = np.zeros((p, p))
    for n, (i, j) in enumerate(cells):
        info[i, j] = info[j, i] = row[f"h{n}"]
    return row["ll"], np.array([row[f"g{i}"] for i in range(p)]), info


@dataclass
class CoxFit:
    covariates: list[str]
    coef: np.ndarray
    information: np.ndarray
    log_likelihood: float
    iterations: int


def cox_fit(
    df: DataFrame, time: str, event: str, xs: Sequence[str], max_iter: int = 30, tol: float = 1e-9
) -> CoxFit:
    """Proportional hazards by Newton-Raphson with Efron's treatment of ties.

    The rows are first reduced to distinct (duration, event, covariates) with their number. Durations may be
    real numbers, and any number of deaths may be tied. Raises when no step raises the likelihood, or after ``max_iter`` steps without convergence.
    """
    patterns = checkpointed(
        df.dropna(subset=[time, event, *xs]).groupBy(time, event, *xs).agg(F.count("*").alias("n"))
    )
    n = F.col("n").cast("double")
    *centre, died, times = patterns.agg(*[F.sum(F.col(c) * n) / F.sum(n) for c in xs], F.max(F.col(event) == 1),
                                        F.count_distinct(time)).first()
    if not died:
        raise ValueError("no event to fit")
    many = times > TIMES
    beta = np.zeros(len(xs))
    ll, grad, info = _cox_sums(patterns, time, event, xs, centre, many, beta)
    rounds = 0
    for rounds in range(1, max_iter + 1):
        step = np.linalg.lstsq(info, grad, rcond=None)[0]
        size = 1.0
        while True:
            new = beta + size * step
            new_ll, new_grad, new_info = _cox_sums(patterns, time, event, xs, centre, many, new)
            if new_ll >= ll - 1e-9 * abs(ll) or size < 1e-3:
                break
            size /= 2
        if not new_ll >= ll - 1e-9 * abs(ll):
            raise RuntimeError(f"Cox fit: no step raises the likelihood after {rounds} steps")
        gain, beta, ll, grad, info = abs(new_ll - ll), new, new_ll, new_grad, new_info
        if np.max(np.abs(size * step)) < tol or gain < tol * 1e-3 * (abs(ll) + 1):
            break
    else:
        raise RuntimeError(f"Cox fit has not converged after {max_iter} steps")
    return CoxFit(list(xs), beta, info, ll, rounds)


def cox_summary(spark: SparkSession, fit: CoxFit) -> DataFrame:
    """One row per covariate with coefficient, hazard ratio, errors, intervals and p value."""
    rows = []
    for name, b, s in zip(fit.covariates, fit.coef, np.sqrt(np.diag(np.linalg.pinv(fit.information)))):
        low, high, z = b - Z95 * s, b + Z95 * s, b / s
        p = math.erfc(abs(z) / math.sqrt(2))
        rows.append((name, float(b), math.exp(b), float(s), float(low), float(high), math.exp(low), math.exp(high),
                     float(z), p, -math.log2(p) if p > 0 else float("inf")))
    return spark.createDataFrame(rows, COX_TABLE)
