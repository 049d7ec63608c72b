"""Binomial regression tables: odds ratios, standard errors, intervals, aliased terms."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpointed
from ..sources.schemas import GLM_TABLE
from .features import complete_cases

Z95 = 1.959963984540054
INTERCEPT = "(Intercept)"


def covariate_patterns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Complete rows, one per distinct combination of ``columns``, with their number ``n``.

    Cohort models have few distinct covariate values, so this is usually tiny next to the rows.
    """
    return complete_cases(df.select(*columns), columns).groupBy(*columns).agg(F.count("*").alias("n"))


def gram_matrix(df: DataFrame, xs: Sequence[str], weight: str | None = None) -> np.ndarray:
    """Cross products of (1, xs), summed per partition and then over partitions; p x p numbers return."""
    p = len(xs) + 1

    def cross(batches):
        total = np.zeros((p, p))
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), pdf[list(xs)].to_numpy(dtype=float)])
            w = pdf[weight].to_numpy(dtype=float) if weight else np.ones(len(pdf))
            total += (x * w[:, None]).T @ x
        i, j = np.indices((p, p))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    sums = df.mapInPandas(cross, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((p, p))
    for r in sums:
        out[r.i, r.j] = r.v
    return out


def alias_columns(df: DataFrame, xs: Sequence[str], weight: str | None = None, tol: float = 1e-9) -> list[str]:
    """Columns that depend linearly on the intercept and the columns before them."""
    g = gram_matrix(df, xs, weight)
    scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
    g = g / np.outer(scale, scale)
    kept, aliased = [0], []
    for j, name in enumerate(xs, start=1):
        own = g[j, j] - g[j, kept] @ np.linalg.solve(g[np.ix_(kept, kept)], g[kept, j])
        if own <= tol:
            aliased.append(name)
        else:
            kept.append(j)
    return aliased


def _sums(x: np.ndarray, label: np.ndarray, n: np.ndarray, betas: np.ndarray) -> np.ndarray:
    """Per coefficient vector: deviance, gradient and information of some patterns, in one row."""
    m, p = betas.shape
    total = np.zeros((m, 1 + p + p * p))
    for k in range(m):
        eta = x @ betas[k]
        small = np.exp(-np.abs(eta))
        mu = np.where(eta >= 0, 1.0, small) / (1.0 + small)
        total[k, 0] = 2.0 * np.sum(n * (np.logaddexp(0.0, eta) - label * eta))
        total[k, 1 : 1 + p] = x.T @ (n * (label - mu))
        total[k, 1 + p :] = ((x * (n * mu * (1.0 - mu))[:, None]).T @ x).ravel()
    return total


def _parts(total: np.ndarray, p: int):
    return total[:, 0], total[:, 1 : 1 + p], total[:, 1 + p :].reshape(len(total), p, p)


def _design(pdf: pd.DataFrame, y: str, xs: Sequence[str]):
    x = np.column_stack([np.ones(len(pdf)), pdf[list(xs)].to_numpy(dtype=float)])
    return x, pdf[y].to_numpy(dtype=float), pdf["n"].to_numpy(dtype=float)


def _logit_sums(patterns: DataFrame, y: str, xs: Sequence[str], betas: np.ndarray):
    """Deviance, gradient and information of several coefficient vectors at once, in one pass."""
    m, p = betas.shape

    def sums(batches):
        total = np.zeros((m, 1 + p + p * p))
        for pdf in batches:
            total += _sums(*_design(pdf, y, xs), betas)
        k, i = np.indices(total.shape)
        yield pd.DataFrame({"k": k.ravel(), "i": i.ravel(), "v": total.ravel()})

    out = np.zeros((m, 1 + p + p * p))
    found = patterns.mapInPandas(sums, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).toPandas()
    out[found["k"], found["i"]] = found["v"]
    return _parts(out, p)


REACH = 60.0  # a limit farther than this from the estimate, in linear-predictor units, is infinite
STEP_REACH = 6.0
NEWTON_STEPS = 200
SEARCH_STEPS = 60
SETTLED = 1e-12  # what a Newton step may still gain, relative to the deviance
LOCAL_BYTES = 32 << 20  # patterns up to this size go to every task


def _newton_step(info: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """A Newton step that also moves along directions whose information has all but vanished."""
    ridge = 1e-10 * max(1.0, float(np.max(np.diag(info), initial=0.0)))
    return np.linalg.solve(info + ridge * np.eye(len(grad)), grad)


def _descend(start: np.ndarray, free: Sequence[int], scales: np.ndarray):
    """Minimise the deviance over the ``free`` coefficients, by bounded Newton steps halved until they help.

    A generator: yields coefficient vectors and is sent (deviance, gradient, information) of each. Returns the
    coefficients, what was sent for them, and the last step taken. Where the data are separated the deviance
    settles while the coefficients still run away.
    """
    b, free, last = start.copy(), list(free), np.zeros(len(start))
    deviance, grad, info = yield b
    for _ in range(NEWTON_STEPS if free else 0):
        step = _newton_step(info[np.ix_(free, free)], grad[free])
        if grad[free] @ step < SETTLED * (1.0 + deviance):
            break
        step *= min(1.0, STEP_REACH / float(np.max(np.abs(step) * scales[free])))
        gain = float(grad[free] @ step)
        share = 1.0
        while share > 1e-6:
            trial = b.copy()
            trial[free] += share * step
            found = yield trial
            if found[0] <= deviance - 1e-4 * share * gain:
                last = trial - b
                b, (deviance, grad, info) = trial, found
                break
            share /= 2
        else:
            break  # nothing along the step is better: as low as the numbers go
    else:
        if free:
            raise RuntimeError("a regression did not converge")
    return b, (deviance, grad, info), last


def _constrained_fit(start: np.ndarray, j: int, fixed: float, scales: np.ndarray):
    """Minimise the deviance with coefficient ``j`` fixed; a generator like ``_descend``."""
    b = start.copy()
    b[j] = fixed
    b, found, _ = yield from _descend(b, [i for i in range(len(b)) if i != j], scales)
    return b, found[0]


def recession(patterns: DataFrame, y: str, xs: Sequence[str], step: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """The direction in which the likelihood never falls, if ``step``, the last one taken, shows one; else zeros.

    Along such a direction every pattern with events only moves up or stays, every pattern without moves down or
    stays, and some do move. The candidate is held against all patterns, in one pass.
    """
    moved = np.abs(step) * scales
    if moved.max(initial=0.0) < 0.02:
        return np.zeros(len(step))
    d = np.where(moved < 0.02 * moved.max(), 0.0, step)
    terms = [F.lit(float(d[0])), *[F.col(f"`{x}`").cast("double") * float(v) for x, v in zip(xs, d[1:], strict=True)]]
    along = sum(terms[1:], terms[0]) * (2 * F.col(y) - 1)
    least, most = patterns.agg(F.min(along), F.max(along)).first()
    return d if most > 0 and least >= -0.05 * most else np.zeros(len(step))


def _profile_limit(j: int, side: float, beta: np.ndarray, se: float, scales: np.ndarray, base: float):
    """One profile limit; a generator like ``_constrained_fit``. Infinite if the deviance never rises enough."""
    scale = scales[j]
    width = min(Z95 * se, 2.0 / scale)
    low, z_low, start = beta[j], -Z95, beta
    while True:
        high = beta[j] + side * width
        start, deviance = yield from _constrained_fit(start, j, high, scales)
        z_high = np.sqrt(max(deviance - base, 0.0)) - Z95
        if z_high >= 0:
            break
        if width * scale > REACH:
            return side * np.inf
        low, z_low, width = high, z_high, 2 * width
    for _ in range(SEARCH_STEPS):  # regula falsi, the stale end's value halved
        if abs(z_high) < 1e-9 or abs(high - low) * scale < 1e-11:
            return high
        at = high - z_high * (high - low) / (z_high - z_low)
        start, deviance = yield from _constrained_fit(start, j, at, scales)
        z = np.sqrt(max(deviance - base, 0.0)) - Z95
        if z * z_high < 0:
            low, z_low = high, z_high
        else:
            z_low /= 2
        high, z_high = at, z
    raise RuntimeError("a profile limit did not converge")


def profile_bounds(
    patterns: DataFrame, y: str, xs: Sequence[str], beta: np.ndarray, se: np.ndarray, toward: np.ndarray
) -> np.ndarray:
    """Profile-likelihood limits per coefficient (intercept first), as (p, 2).

    A limit is where the deviance, minimised over the other coefficients, has risen by the squared
    normal quantile; where ``toward`` says that a coefficient runs away, it is infinite. Patterns of proven small
    size go to one task per limit. Otherwise all limits are searched side by side: every pass over the data
    serves the next question of each search that is still open.
    """
    base = _logit_sums(patterns, y, xs, beta[None, :])[0][0]
    scales = _scales(patterns, xs)
    limits = np.zeros((len(beta), 2))
    wanted = []
    for j in range(len(beta)):
        for k, side in enumerate((-1.0, 1.0)):
            if toward[j] * side > 0:
                limits[j, k] = side * np.inf
            else:
                wanted.append((j, k, side))
    search = lambda j, side: _profile_limit(j, side, beta, se[j], scales, base)
    if patterns.count() * (len(xs) + 2) * 8 <= LOCAL_BYTES:
        table = patterns.select(y, *xs, "n").toPandas()
        shared = patterns.sparkSession.sparkContext.broadcast(_design(table, y, xs))

        def run(frames):
            for frame in frames:
                for at in frame["id"]:
                    j, _, side = wanted[at]
                    yield pd.DataFrame({"at": [at], "value": [_alone(search(j, side), *shared.value)]})

        found = patterns.sparkSession.range(0, len(wanted), 1, len(wanted)).mapInPandas(run, "at long, value double").collect()
        for at, value in found:
            limits[wanted[at][:2]] = value
        return limits
    searches = {(j, k): search(j, side) for j, k, side in wanted}
    asked = {at: next(s) for at, s in searches.items()}
    while asked:
        order = list(asked)
        found = _logit_sums(patterns, y, xs, np.array([asked[at] for at in order]))
        for at, *answer in zip(order, *found, strict=True):
            try:
                asked[at] = searches[at].send(answer)
            except StopIteration as done:
                limits[at] = done.value
                del asked[at]
    return limits


def _alone(search, x: np.ndarray, label: np.ndarray, n: np.ndarray):
    """Run one search over patterns in memory."""
    asked = next(search)
    while True:
        deviance, grad, info = _parts(_sums(x, label, n, asked[None, :]), len(asked))
        try:
            asked = search.send((deviance[0], grad[0], info[0]))
        except StopIteration as done:
            return done.value


def _scales(patterns: DataFrame, xs: Sequence[str]) -> np.ndarray:
    """The largest absolute value of each column, the intercept's first."""
    largest = patterns.agg(*[F.max(F.abs(F.col(f"`{x}`").cast("double"))) for x in xs]).first() if xs else ()
    return np.array([1.0, *(float(m or 1.0) for m in largest)])


def _fitted(patterns: DataFrame, y: str, xs: Sequence[str], scales: np.ndarray):
    """The maximum-likelihood fit, one pass per step: coefficients, information, last step."""
    search = _descend(np.zeros(len(xs) + 1), range(len(xs) + 1), scales)
    asked = next(search)
    while True:
        deviance, grad, info = _logit_sums(patterns, y, xs, asked[None, :])
        try:
            asked = search.send((deviance[0], grad[0], info[0]))
        except StopIteration as done:
            beta, (_, _, info), last = done.value
            return beta, info, last


def glm_binomial(df: DataFrame, y: str, xs: Sequence[str], ci: str = "profile") -> DataFrame:
    """Logit model as a table of odds ratios, one row per term in formula order.

    Terms that depend linearly on earlier ones get a row of nulls, and so does every term without any
    complete row. ``ci`` is ``profile`` or ``wald``
    and is named in the output. A term that the data separate has an infinite estimate (an odds ratio of 0 or
    infinity), standard error and limit on that side, statistic 0 and p value 1, as the limits of a diverging fit;
    any other limit is infinite where the deviance never rises enough. A fit or a limit that does not converge raises.
    """
    spark = df.sparkSession
    patterns = checkpointed(covariate_patterns(df, [y, *xs]))
    if patterns.isEmpty():
        return spark.createDataFrame([(name, *[None] * 6, ci) for name in [INTERCEPT, *xs]], GLM_TABLE)
    aliased = set(alias_columns(patterns, xs, "n"))
    kept = [x for x in xs if x not in aliased]
    scales = _scales(patterns, kept)
    beta, info, last = _fitted(patterns, y, kept, scales)
    toward = recession(patterns, y, kept, last, scales)
    se = np.sqrt(np.diag(np.linalg.inv(info + 1e-12 * np.max(np.diag(info), initial=1e-300) * np.eye(len(beta)))))
    if ci == "profile":
        bounds = profile_bounds(patterns, y, kept, beta, se, toward)
    else:
        bounds = np.column_stack([beta - Z95 * se, beta + Z95 * se])
        bounds[toward != 0] = -np.inf, np.inf
    beta, se = np.where(toward != 0, np.copysign(np.inf, toward), beta), np.where(toward != 0, np.inf, se)
    rows = {}
    for name, b, s, (low, high) in zip([INTERCEPT, *kept], beta, se, bounds):
        z = 0.0 if math.isinf(s) else b / s
        with np.errstate(over="ignore"):  # a separated term has an unbounded interval
            odds, odds_low, odds_high = (float(v) for v in np.exp([b, low, high]))
        rows[name] = (name, odds, float(s), float(z), math.erfc(abs(z) / math.sqrt(2)), odds_low, odds_high, ci)
    ordered = [rows.get(name, (name, *[None] * 6, ci)) for name in [INTERCEPT, *xs]]
    return spark.createDataFrame(ordered, GLM_TABLE)
