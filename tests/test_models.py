import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspan.operators import attribution as A
from cohortspan.operators import glm, models, survival
from cohortspan.plans.queries import QUERIES


@pytest.fixture(scope="module")
def cohort(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        arm = i % 3
        score = rng.randint(0, 5)
        doses = rng.randint(0, 3)
        p = 1 / (1 + math.exp(2.0 - 0.4 * score - 0.6 * (arm == 0) + 0.3 * doses))
        death = int(rng.random() < p)
        duration = rng.randint(0, 60) if death else rng.randint(20, 80)
        rows.append((i, int(arm == 0), int(arm == 1), int(arm == 2), score, doses, death, duration))
    return spark.createDataFrame(
        rows, "id long, a int, b int, c int, score int, doses int, death int, duration int"
    ).cache()


def newton_logit(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x, x.T @ (y - mu))
    mu = 1 / (1 + np.exp(-x @ beta))
    return beta, np.sqrt(np.diag(np.linalg.inv((x * (mu * (1 - mu))[:, None]).T @ x)))


def test_glm_drops_aliased_arm_and_matches_newton(cohort):
    xs = ["a", "b", "c", "doses", "score"]
    out = glm.glm_binomial(cohort, "death", xs, ci="wald").collect()
    assert [r.term for r in out] == ["(Intercept)", *xs]
    assert out[3].estimate is None and out[3].p_value is None
    pdf = cohort.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf[["a", "b", "doses", "score"]]])
    beta, se = newton_logit(x, pdf["death"].to_numpy())
    got = [r for r in out if r.term != "c"]
    assert np.allclose([math.log(r.estimate) for r in got], beta, atol=1e-6)
    assert np.allclose([r.std_error for r in got], se, atol=1e-6)


def test_profile_limits_of_separated_and_aliased_terms(spark):
    """Adults outside all groups have no event: intercept and groups are separated together."""
    rows = [(g, int(g == k), int(g == 3), e) for g, n, events in ((0, 30, 0), (1, 60, 12), (2, 50, 4)) for k in (1,) for e in
            [1] * events + [0] * (n - events)]
    df = spark.createDataFrame([(float(g == 1), float(g == 2), float(g != 0), c, e) for g, _, c, e in rows],
                               "g1 double, g2 double, either double, never int, y int")
    out = {r.term: r for r in glm.glm_binomial(df, "y", ["g1", "g2", "either", "never"]).collect()}
    assert out["either"].estimate is None and out["never"].estimate is None
    assert out["(Intercept)"].conf_low == 0 and 0 < out["(Intercept)"].conf_high < 1
    assert out["g1"].conf_high == math.inf and 1 < out["g1"].conf_low < math.inf
    two = spark.createDataFrame([(1.0, 1)] * 12 + [(1.0, 0)] * 48 + [(0.0, 1)] * 4 + [(0.0, 0)] * 46, "x double, y int")
    limits = {r.term: r for r in glm.glm_binomial(two, "y", ["x"]).collect()}["x"]

    def rise(b):  # of the 2x2 table, the intercept minimised by bisection
        low, high = -30.0, 30.0
        for _ in range(200):
            a = (low + high) / 2
            p1, p0 = 1 / (1 + math.exp(-a - b)), 1 / (1 + math.exp(-a))
            low, high = (a, high) if 16 > 60 * p1 + 50 * p0 else (low, a)
        return -2 * (12 * math.log(p1) + 48 * math.log(1 - p1) + 4 * math.log(p0) + 46 * math.log(1 - p0))

    best = rise(math.log(limits.estimate))
    for bound in (limits.conf_low, limits.conf_high):
        assert abs(rise(math.log(bound)) - best - 3.841458820694124) < 1e-5


def test_separated_aliased_and_plain_terms(spark, monkeypatch):
    """Only rows without the sign survive: its odds are infinite, the other terms' are those of the rest."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        sign, x = float(i % 8 == 0), float(rng.randint(0, 4))
        rows.append((sign, 1.0 - sign, x, 1 if sign else int(rng.random() < 1 / (1 + math.exp(1.5 - 0.5 * x)))))
    df = spark.createDataFrame(rows, "sign double, none double, x double, y int")
    out = {r.term: r for r in glm.glm_binomial(df, "y", ["sign", "none", "x"]).collect()}
    rest = {r.term: r for r in glm.glm_binomial(df.filter("sign = 0"), "y", ["x"]).collect()}
    assert out["none"].estimate is None
    assert out["sign"].estimate == out["sign"].conf_high == out["sign"].std_error == math.inf and 1 < out["sign"].conf_low < math.inf
    assert out["sign"].statistic == 0 and out["sign"].p_value == 1
    for name in ("estimate", "std_error", "conf_low", "conf_high"):
        assert getattr(out["x"], name) == pytest.approx(getattr(rest["x"], name), rel=1e-5)
    monkeypatch.setattr(glm, "LOCAL_BYTES", 0)
    again = {r.term: r for r in glm.glm_binomial(df, "y", ["sign", "none", "x"]).collect()}
    assert again["sign"].conf_low == pytest.approx(out["sign"].conf_low) and again["x"].conf_high == pytest.approx(out["x"].conf_high)
    assert glm.glm_binomial(df, "y", ["sign"], ci="wald").filter("term = 'sign'").first().conf_low == 0


def test_profile_bounds_raise_deviance_by_the_quantile(cohort):
    wald = {r.term: r for r in glm.glm_binomial(cohort, "death", ["score"], ci="wald").collect()}
    out = {r.term: r for r in glm.glm_binomial(cohort, "death", ["score"], ci="profile").collect()}
    pdf = cohort.toPandas()
    y, s = pdf["death"].to_numpy(), pdf["score"].to_numpy()

    def deviance(slope):
        b0 = 0.0
        for _ in range(60):
            mu = 1 / (1 + np.exp(-(b0 + slope * s)))
            b0 += np.sum(y - mu) / np.sum(mu * (1 - mu))
        eta = b0 + slope * s
        return 2 * np.sum(np.logaddexp(0, eta) - y * eta)

    best = deviance(math.log(out["score"].estimate))
    for bound in (out["score"].conf_low, out["score"].conf_high):
        assert abs(deviance(math.log(bound)) - best - 3.841458820694124) < 1e-4
    assert abs(out["score"].conf_low - wald["score"].conf_low) < 0.1


def test_cox_equals_brute_force_efron(spark, cohort):
    xs = ["score", "a", "b", "doses"]
    fit = survival.cox_fit(cohort, "duration", "death", xs)
    pdf = cohort.toPandas()
    x, t, e = pdf[xs].to_numpy(float), pdf["duration"].to_numpy(), pdf["death"].to_numpy()

    def grad(beta):
        w = np.exp(x @ beta)
        g = np.zeros(len(xs))
        for time in np.unique(t[e == 1]):
            risk, dead = t >= time, (t == time) & (e == 1)
            d = dead.sum()
            s0, s1 = w[risk].sum(), (w[risk, None] * x[risk]).sum(0)
            e0, e1 = w[dead].sum(), (w[dead, None] * x[dead]).sum(0)
            g += x[dead].sum(0)
            for k in range(d):
                g -= (s1 - k / d * e1) / (s0 - k / d * e0)
        return g

    assert np.max(np.abs(grad(fit.coef))) < 1e-6
    step = 1e-5
    numeric = np.column_stack([
        -(grad(fit.coef + step * np.eye(4)[i]) - grad(fit.coef - step * np.eye(4)[i])) / (2 * step) for i in range(4)
    ])
    assert np.allclose(numeric, fit.information, rtol=1e-4, atol=1e-4)
    table = survival.cox_summary(spark, fit).collect()
    assert [r.covariate for r in table] == xs and all(0 <= r.p <= 1 for r in table)


def test_km_when_everyone_dies_at_the_end(spark):
    df = spark.createDataFrame([("x", 5, 1), ("x", 5, 1), ("x", 2, 1), ("x", 3, 0)], "arm string, duration int, death int")
    out = survival.km_band(survival.km_curve(df, "duration", "death", "arm"), "arm").orderBy("duration").collect()
    assert [r.survival for r in out] == pytest.approx([0.75, 0.75, 0.0])
    assert out[2].lower95 is None and out[0].lower95 < 0.75 < out[0].upper95


def test_logistic_matches_penalised_newton(cohort):
    df = models.assemble(cohort, ["score", "doses"]).cache()
    model = models.logistic("death")(df)
    pdf = cohort.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf[["score", "doses"]]])
    y, beta, pen = pdf["death"].to_numpy(), np.zeros(3), np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x + pen, x.T @ (y - mu) - pen @ beta)
    assert np.allclose([model.intercept, *model.coefficients.toArray()], beta, atol=1e-3)


def test_cross_scores_cover_every_row_once_per_repeat(spark, cohort):
    from cohortspan.operators.evaluate import stratified_folds

    folded = stratified_folds(cohort.select("id", "death", "score", "doses"), "death", "id", 3, 1)
    folded = models.prepared_folds(folded, ["score", "doses"], ["id", "death"])
    fits = models.cross_fit(folded, models.logistic("death"))
    out = models.cross_score(folded, fits, ["id", "death"])
    assert out.count() == 600 and out.select("id").distinct().count() == 600
    lin = A.linear_attribution(fits[(0, 0)].coefficients.toArray(), cohort, ["id"], ["score", "doses"])
    assert abs(lin.agg(F.sum("attribution")).first()[0]) < 1e-6


def test_cox_raises_without_convergence(spark, cohort):
    with pytest.raises(RuntimeError, match="not converged"):
        survival.cox_fit(cohort, "duration", "death", ["score"], max_iter=1)


@pytest.mark.parametrize("d,s0,e0", [(1, 5.0, 1.0), (7, 9.0, 9.0), (1024, 4e3, 1e3), (5000, 5e3, 5e3), (5001, 7.0, 1e-4), (300_000, 9e5, 8.9e5)])
def test_tie_sums_of_any_number_of_deaths(d, s0, e0):
    share = np.arange(d) / d
    den = s0 - share * e0
    want = [np.log(den).sum(), *(v.sum() for v in (1 / den, share / den, den**-2, share / den**2, share**2 / den**2))]
    pad = [1, 3, 1024]  # other times in the same call
    got = survival._tie_sums(*(pd.Series([*[x] * 3, y]) for x, y in ((9.0, s0), (2.0, e0))), pd.Series([*pad, d]))
    assert np.allclose(got.iloc[3], want, rtol=1e-10, atol=1e-300)
    assert np.isclose(got["a0"][1], sum(1 / (9.0 - i / 3 * 2.0) for i in range(3)))


def test_cox_takes_real_times_in_parts(spark, cohort, monkeypatch):
    timed = cohort.withColumn("time", F.col("duration") + F.pmod("id", F.lit(7)) / 7.0)
    whole = survival.cox_fit(timed, "time", "death", ["score", "a"])
    monkeypatch.setattr(survival, "TIMES", 40)
    parts = survival.cox_fit(timed, "time", "death", ["score", "a"])
    assert np.allclose(whole.coef, parts.coef, atol=1e-9) and np.allclose(whole.information, parts.information, rtol=1e-8)


def test_scatter_keeps_values_and_attributions_of_the_same_rows(spark):
    rows = [("up", float(i), float(i)) for i in range(80)] + [("down", float(i % 2), -0.1 * (i % 2)) for i in range(50)]
    rows += [("up", None, 1000.0), ("least", 1.0, 0.0)]
    frame = spark.createDataFrame(rows, "feature string, value double, attribution double")
    found = A.attribution_scatter(frame, k=2).collect()
    assert {r.feature for r in found} == {"up", "down"}
    for r in found:
        if r.feature == "up" and r.low is not None:
            assert r.low <= r.attribution <= r.high and r.n == 10
        elif r.feature == "up":
            assert (r.bin, r.n, r.attribution) == (None, 1, 1000.0)
        else:
            assert r.low == r.high and r.attribution == -0.1 * r.low and r.n == 25
    assert A.attribution_scatter(frame.limit(0)).count() == 0
