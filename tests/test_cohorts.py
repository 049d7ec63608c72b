import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspan.functions import expr as X
from cohortspan.operators import cohorts, describe, features

D = dt.date


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_consolidation_and_history_edges(spark):
    micro = spark.createDataFrame([
        (1, 10, D(2020, 1, 1), D(2020, 1, 1)), (1, 11, D(2020, 1, 1), D(2020, 1, 1)),
        (1, 12, D(2020, 1, 3), D(2020, 1, 1)), (1, 13, D(2020, 1, 5), None), (1, 14, D(2020, 1, 5), None),
        (2, 15, D(2020, 1, 9), None), (3, 16, D(2020, 2, 1), None),
    ], "person_id long, visit_id long, visit_start_date date, macrovisit_start_date date")
    merged = cohorts.consolidate_visits(micro, keep_id="visit_id")
    assert rows(merged, "visit_id") == [(10,), (13,), (15,), (16,)]
    index = spark.createDataFrame([(1, D(2020, 1, 5)), (2, D(2020, 1, 9)), (3, D(2020, 1, 1))], "person_id long, index_date date")
    history = cohorts.visit_history(cohorts.consolidate_visits(micro), index)
    # The index day counts for the span but not for the visits before it.
    assert rows(history, "person_id", "visits_before", "observation_before") == [(1, 1, 4), (2, None, 0), (3, None, None)]
    rate = history.select("person_id", X.safe_rate("visits_before", "observation_before").alias("r"),
                          X.log_rate("visits_before", "observation_before").alias("l"))
    assert rows(rate.filter("person_id > 1"), "r", "l") == [(None, 0.0), (None, 0.0)]


def test_keep_first_and_group_size(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 2, "a"), (1, 1, "z"), (2, 5, "q")], "k int, o int, v string")
    assert rows(cohorts.keep_first(df, ["k"], ["o"]), "k", "v") == [(1, "z"), (2, "q")]
    assert rows(cohorts.dedup(df, ["k"]), "k", "o", "v") == [(1, 1, "z"), (2, 5, "q")]
    assert rows(cohorts.keep_groups_of_size(df, "k", 3), "k") == [(1,)] * 3


def test_flags_and_sites_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, None, 5), (2, None, 0, None), (3, 0, 1, 6)], "person_id int, a int, b int, site int")
    assert rows(df.filter(X.any_flag(["a", "b"])), "person_id") == [(1,), (3,)]
    members = df.filter("a = 1 OR site IS NULL")
    assert rows(cohorts.in_set_flag(df, members, "site", "f"), "person_id", "f") == [(1, 1), (2, 0), (3, 0)]
    one_sided = cohorts.common_keys(df, df.filter("site = 6"), "site")
    assert rows(one_sided[0], "person_id") == [(3,)]


def test_funnel_never_grows_and_counts_nulls_out(spark):
    df = spark.createDataFrame([(20, 1), (30, None), (None, 1), (10, 1)], "age int, flag int")
    got = rows(cohorts.funnel(df, [("adult", F.col("age") >= 18), ("flag", F.col("flag") == 1)]), "step", "name", "n")
    assert got == [(0, "all", 4), (1, "adult", 2), (2, "flag", 1)]


def test_age_sixty_six_and_fractions(spark):
    df = spark.createDataFrame([(66.0,), (65.5,), (45.5,), (67.0,), (None,)], "age double")
    groups = features.age_groups(df)
    assert rows(groups.filter("age IN (66, 65.5, 45.5)"), "age_under45", "age_46to65", "age_66plus") == [(0, 0, 0)] * 3
    assert groups.agg(F.sum("age_66plus")).first()[0] == 1
    summary = {r.value_name: r for r in describe.cohort_summary(
        df.withColumns({"race_ethnicity": F.lit("Unknown"), "sex": F.lit(None).cast("string")})).collect()}
    assert summary["8.Age higher than 66 (in %)"].count_value == 2
    assert summary["9.Age missing (in %)"].count_percent == "1.0(20.0%)"
    assert summary["mean_age"].count_value is None and summary["mean_age"].count_percent == "nan(61.0%)"
    assert "Sex_None" in summary and "Race_Ethnicity_Missing/Unknown" in summary


def test_survival_target_edges(spark):
    cohort = spark.createDataFrame([
        (1, D(2020, 1, 1), 1), (2, D(2020, 1, 1), 1), (3, D(2021, 1, 1), 1), (4, D(2020, 1, 1), 0),
    ], "person_id int, index_date date, death int")
    deaths = spark.createDataFrame([
        (1, D(2020, 1, 11)), (1, D(2020, 1, 5)), (3, D(2020, 1, 1)), (2, None),
    ], "person_id int, death_date date")
    out = features.survival_target(cohort, deaths, "2020-12-31")
    # Two records: the earliest. No date, or a death before the index: the person leaves.
    assert rows(out, "person_id", "duration") == [(1, 4), (4, 365)]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7), (2.0, None, 7), (3.0, 6.5, 7), (4.0, 7.0, 7)], "a double, b double, c int")
    got = {(r.row_name, r.col_name): r.r for r in describe.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert got[("c", "c")] is None and got[("a", "c")] is None
    want = np.corrcoef([1.0, 3.0, 4.0], [2.0, 6.5, 7.0])[0, 1]
    assert got[("a", "b")] == got[("b", "a")] == pytest.approx(want)


def test_disjoint_check_with_an_empty_arm(spark):
    a = spark.createDataFrame([(1,), (2,)], "person_id int")
    out = cohorts.disjoint_check({"x": a, "y": a.filter("person_id = 2"), "z": a.filter("false")})
    assert rows(out, "pair", "n") == [("x|y", 1), ("x|z", 0), ("y|z", 0)]


def test_mean_fill_keeps_fractions(spark):
    df = spark.createDataFrame([(1,), (None,), (4,)], "v int")
    assert rows(features.fill_mean(df, ["v"]), "v") == [(1.0,), (2.5,), (4.0,)]


def test_strip_suffix_and_odds_table(spark):
    df = spark.createDataFrame([(1, 2)], "X_flag int, y int")
    assert X.strip_suffix(df, "_flag").columns == ["X", "y"]
    table = spark.createDataFrame([
        ("a", 2.0, 0.1, 3.0, 0.01, 1.5, 2.5, "wald"), ("b", 2.0, 0.1, 3.0, 0.2, 1.5, 12.0, "wald"),
        ("c", None, None, None, None, None, None, "wald"),
    ], "term string, estimate double, std_error double, statistic double, p_value double, conf_low double, conf_high double, conf_method string")
    assert rows(describe.odds_ratio_table(table, 10), "term", "significance") == [("a", "Significant")]
    assert describe.odds_ratio_table(table).filter("significance IS NULL").count() == 1


def test_set_membership_never_shuffles_the_cohort_by_a_hot_key(spark, monkeypatch, capsys):
    people = spark.range(200).selectExpr("id AS person_id", "id % 3 AS site_id")
    members = people.filter("person_id = 4")
    for limit in (10, 0):
        monkeypatch.setattr(cohorts, "SET_ROWS", limit)
        flagged = cohorts.in_set_flag(people, members, "site_id", "flag")
        assert flagged.filter("flag = 1").count() == flagged.filter("site_id = 1").count() == 67
        left, right = cohorts.common_keys(people, members, "site_id")
        assert (left.count(), right.count()) == (67, 1)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        flagged.explain()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        import re
        assert not re.search(r"hashpartitioning\(site_id#\d+L?, \d+\)", capsys.readouterr().out)
