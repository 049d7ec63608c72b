import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspan.operators import cohorts, matching
from cohortspan.operators.matching import match_nearest, matched_data

CALIPERS = {"age": 10, "day": 45, "rate": 1}


def spread(unit):
    return int(hashlib.md5(str(unit).encode()).hexdigest()[:13], 16)


def sequential(rows, replace=False):
    """The rule, one treated unit after another over all controls."""
    treated = sorted((r for r in rows if r["is_case"] == 1), key=lambda r: (-r["score"], r["person_id"]))
    free = {r["person_id"]: r for r in rows if r["is_case"] == 0}
    pairs = set()
    for t in treated:
        best = None
        for c in free.values():
            if c["site"] != t["site"] or any(abs(c[k] - t[k]) > w for k, w in CALIPERS.items()):
                continue
            gap = abs(c["score"] - t["score"])
            ch, th = spread(c["person_id"]), spread(t["person_id"])
            lower = (c["score"], ch) < (t["score"], th)
            tie = abs(ch - th) if gap == 0 else int(not lower)
            key = (gap, tie, int(not lower), -ch if lower else ch)
            if best is None or key < best[0]:
                best = (key, c["person_id"])
        if best:
            pairs.add((t["person_id"], best[1]))
            if not replace:
                del free[best[1]]
    return pairs


def instance(seed, n, case_share=0.4, copies=0.0, digits=2, sites=3):
    rng = random.Random(seed)
    base = None
    rows = []
    for i in range(n):
        row = dict(
            site=0 if rng.random() < 0.6 else rng.randrange(sites),
            age=rng.randint(18, 60), day=rng.randint(0, 200), rate=round(rng.uniform(0, 2), 2),
            score=round(rng.random(), digits),
        )
        if base is not None and rng.random() < copies:
            row = dict(base)
        base = base or dict(row)
        rows.append(dict(row, person_id=i, is_case=int(rng.random() < case_share)))
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows)
    pairs = match_nearest(df, "is_case", "score", "site", CALIPERS, **kw)
    return {(r.treated_id, r.control_id) for r in pairs.collect()}


@pytest.mark.parametrize("kw, chunk_rows", [
    (dict(seed=1, n=300), 100000),
    (dict(seed=3, n=240, copies=0.5), 100000),
    (dict(seed=2, n=110, case_share=0.8), 30),
    (dict(seed=3, n=110, copies=0.5), 30),
    (dict(seed=4, n=110, digits=1), 30),
])
def test_equals_sequential_greedy(spark, kw, chunk_rows):
    rows = instance(**kw)
    assert run(spark, rows, chunk_rows=chunk_rows) == sequential(rows)


def test_with_replacement(spark):
    rows = instance(seed=5, n=120)
    assert run(spark, rows, chunk_rows=40, replace=True) == sequential(rows, replace=True)


def test_no_controls_or_no_cases(spark):
    rows = instance(seed=6, n=20)
    assert run(spark, [dict(r, is_case=1) for r in rows]) == set()
    assert run(spark, [dict(r, is_case=0) for r in rows]) == set()
    assert run(spark, [dict(r, is_case=1) for r in rows], chunk_rows=5) == set()
    assert run(spark, [dict(r, is_case=0) for r in rows], chunk_rows=5) == set()


def test_walks_where_a_block_reaches_too_many_controls(spark):
    rows = instance(seed=8, n=70)
    assert run(spark, rows, chunk_rows=30, most_rows=10) == sequential(rows)
    assert run(spark, rows, chunk_rows=30, most_rows=10, replace=True) == sequential(rows, replace=True)


def test_steps_follow_the_blocks_of_a_group_rather_than_contention(spark, monkeypatch):
    """300 rivals for heavily tied controls: rounds of acceptance took one round per displacement."""
    rows = instance(seed=9, n=600, case_share=0.55, digits=1, sites=1)
    written = []
    plain = matching.checkpointed
    monkeypatch.setattr(matching, "checkpointed", lambda df, *a, **kw: written.append(1) or plain(df, *a, **kw))
    assert run(spark, rows, chunk_rows=100) == sequential(rows)
    assert len(written) <= 12


def test_matched_data_and_surviving_controls(spark):
    rows = instance(seed=7, n=200)
    df = spark.createDataFrame(rows)
    pairs = match_nearest(df, "is_case", "score", "site", CALIPERS)
    matched = matched_data(df, pairs).cache()
    n = pairs.count()
    assert matched.count() == 2 * n and matched.select("subclass").distinct().count() == n
    kept = matched.filter("is_case = 1 AND person_id % 2 = 0")
    got = {r.person_id for r in cohorts.matched_controls(matched, kept).collect()}
    direct = matched.filter("is_case = 0").join(
        kept.select("subclass"), "subclass", "left_semi"
    )
    assert got == {r.person_id for r in direct.collect()} and got


def test_propensity_with_the_group_as_a_factor(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        site, x = "abc"[i % 3], float(rng.normal(50, 10))
        case = int(rng.random() < 1 / (1 + np.exp(-(-4 + 0.06 * x + "abc".index(site)))))
        rows.append((i, site, x, float(i % 5), case))
    rows += [(900 + i, "none", 50.0 + i, 1.0, 0) for i in range(5)] + [(910 + i, "all", 50.0 + i, 1.0, 1) for i in range(5)]
    frame = spark.createDataFrame(rows, "person_id long, site string, x double, z double, is_case int")
    got = {r.person_id: r for r in matching.propensity_by_group(frame, "is_case", ["x", "z"], "site").collect()}
    assert len(got) == len(rows)
    design = np.array([[s == "a", s == "b", s == "c", (x - 50) / 10, z] for i, s, x, z, _ in rows[:900]], float)
    label, beta = np.array([r[4] for r in rows[:900]]), np.zeros(5)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve((design * (mu * (1 - mu))[:, None]).T @ design, design.T @ (label - mu))
    assert np.allclose([got[i].distance for i in range(900)], 1 / (1 + np.exp(-design @ beta)), atol=1e-7)
    assert {got[i].distance for i in range(900, 905)} == {0.0} and {got[i].distance for i in range(910, 915)} == {1.0}
    assert matching.propensity_by_group(frame.limit(0), "is_case", ["x", "z"], "site").count() == 0
    with pytest.raises(ValueError):
        matching.propensity_by_group(frame.withColumn("z", F.expr("nullif(z, 2)")), "is_case", ["x", "z"], "site")
