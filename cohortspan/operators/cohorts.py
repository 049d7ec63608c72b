"""Cohort construction: index dates, visit history, eligibility, arms, funnels, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import any_flag, day_gap, log_rate, min_gap_days, safe_rate
from ..runtime import checkpointed


def latest_event(events: DataFrame, key: str, ts: str, out: str) -> DataFrame:
    return events.groupBy(key).agg(F.max(ts).alias(out))


def first_last_event(events: DataFrame, key: str, ts: str, first: str, last: str) -> DataFrame:
    return events.groupBy(key).agg(F.min(ts).alias(first), F.max(ts).alias(last))


def attach_latest(df: DataFrame, events: DataFrame, key: str, ts: str, out: str) -> DataFrame:
    """Add the latest event per key, reducing the events to one row per key before the join."""
    return df.join(latest_event(events, key, ts, out), key, "left")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the smallest by ``order``, then by the remaining columns.

    A minimum over structs combines before the shuffle, so a key with very many rows never has to
    be sorted in one task, as it would be with a row number.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    return (
        df.groupBy(*keys)
        .agg(F.min(F.struct(*order, *rest)).alias("_first"))
        .select(*keys, "_first.*")
        .select(*df.columns)
    )


def dedup(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per ``keys``, chosen deterministically."""
    return keep_first(df, keys, [])


SET_ROWS = 1_000_000  # a set of at most so many keys is sent to every task
SET_SALTS = 32


def _with_mark(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """``df`` with ``_in`` = 1 where ``key`` occurs among ``members``, else null.

    Few keys may hold all rows of ``df``, so its rows never meet by ``key`` alone: the set is collapsed and
    counted first, then sent to the tasks, or, beyond ``SET_ROWS`` keys, joined in salted copies.
    """
    keys = checkpointed(members.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_in", F.lit(1)))
    if keys.count() <= SET_ROWS:
        return df.join(F.broadcast(keys), key, "left")
    salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SET_SALTS - 1))))
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.lit(SET_SALTS)).cast("int"))
    return spread.join(salted, [key, "_salt"], "left").drop("_salt")


def common_keys(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both frames restricted to key values that occur in the other."""
    return (
        _with_mark(a, b, key).filter("_in = 1").select(*a.columns),
        _with_mark(b, a, key).filter("_in = 1").select(*b.columns),
    )


def in_set_flag(df: DataFrame, members: DataFrame, key: str, out: str) -> DataFrame:
    """1 where ``key`` occurs among ``members``, else 0 (null key included)."""
    return _with_mark(df, members, key).select(*df.columns, F.coalesce("_in", F.lit(0)).alias(out))


def exclude(df: DataFrame, other: DataFrame, key: str = "person_id") -> DataFrame:
    return df.join(other.select(key), key, "left_anti")


def intersect_keys(df: DataFrame, *others: DataFrame, key: str = "person_id") -> DataFrame:
    """Rows whose key occurs in every other frame; semi joins, so nothing is multiplied."""
    for other in others:
        df = df.join(other.select(key), key, "left_semi")
    return df


def keep_groups_of_size(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows of groups with exactly ``size`` rows.

    Counting then semi-joining keeps an oversized group out of any single task.
    """
    wanted = df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") == size)
    return df.join(wanted.select(key), key, "left_semi")


def consolidate_visits(
    micro: DataFrame,
    person: str = "person_id",
    start: str = "visit_start_date",
    macro: str = "macrovisit_start_date",
    keep_id: str | None = None,
) -> DataFrame:
    """Collapse micro-visits.

    Rows of a macro-visit become one row per (person, macro start) with the earliest start; the
    others one row per (person, start). Both rules are the same grouped minimum over a derived
    day, so one scan and one shuffle do.
    """
    grouped = micro.groupBy(
        person, F.col(macro).isNotNull().alias("_in_macro"), F.coalesce(macro, start).alias("_day")
    )
    if keep_id is None:
        kept = grouped.agg(F.min(start).alias(start))
    else:
        kept = grouped.agg(F.min(F.struct(start, keep_id)).alias("_first")).select(
            person, "_in_macro", "_day", "_first.*"
        )
    out = [person, *([keep_id] if keep_id else []), start]
    return kept.select(*out, F.when(F.col("_in_macro"), F.col("_day")).alias(macro))


def visit_history(
    visits: DataFrame,
    index: DataFrame,
    key: str = "person_id",
    start: str = "visit_start_date",
    index_date: str = "index_date",
    n_out: str = "visits_before",
    span_out: str = "observation_before",
) -> DataFrame:
    """Visits strictly before the index date, and the span from first to last visit up to it.

    Null where there is nothing to count or to span. One grouped pass gives both.
    """
    gap = day_gap(index_date, start)
    seen = F.when(gap >= 0, F.col(start))
    return (
        visits.join(index.select(key, index_date), key)
        .groupBy(key)
        .agg(
            F.nullif(F.count(F.when(gap > 0, 1)), F.lit(0)).cast("int").alias(n_out),
            F.datediff(F.max(seen), F.min(seen)).alias(span_out),
        )
    )


def eligible_followup(df: DataFrame, latest: str, index_date: str, days: int = 45) -> DataFrame:
    return df.filter(min_gap_days(latest, index_date, days))


def _with_rates(df: DataFrame, label: int) -> DataFrame:
    return df.withColumns({
        "is_case": F.lit(label),
        "visit_rate": safe_rate("visits_before", "observation_before"),
        "log_visit_rate": log_rate("visits_before", "observation_before"),
    })


def case_cohort(
    positive: DataFrame,
    visits: DataFrame,
    flags: Sequence[str],
    gap: int = 45,
    min_age: int = 18,
    age: str = "age",
    milestone: str = "2021-10-01",
) -> DataFrame:
    """Index-positive adults with follow-up and any of the flags."""
    adults = positive.filter((F.col(age) >= min_age) & any_flag(flags))
    df = attach_latest(adults, visits, "person_id", "visit_start_date", "latest_visit_date")
    df = eligible_followup(df, "latest_visit_date", "index_date", gap)
    return _with_rates(df.withColumn("milestone_date", F.lit(milestone).cast("date")), 1)


def positive_control(
    positive: DataFrame,
    visits: DataFrame,
    cases: DataFrame,
    gap: int = 45,
    min_age: int = 18,
    age: str = "age",
    site: str = "site_id",
    dx: str = "dx",
    milestone: str = "2021-10-01",
) -> DataFrame:
    """Index-positive adults with follow-up who are not cases, marked by whether their site diagnoses."""
    df = attach_latest(
        positive.filter(F.col(age) >= min_age), visits, "person_id", "visit_start_date", "latest_visit_date"
    )
    df = eligible_followup(df, "latest_visit_date", "index_date", gap)
    df = exclude(df, cases)
    df = in_set_flag(df, positive.filter(F.col(dx) == 1), site, "is_dx_site")
    return _with_rates(df.withColumn("milestone_date", F.lit(milestone).cast("date")), 0)


def negative_control(
    persons: DataFrame,
    visits: DataFrame,
    micro_visits: DataFrame,
    cases: DataFrame,
    gap: int = 45,
    min_age: int = 18,
    index: str = "neg_date",
    site: str = "site_id",
    dx: str = "dx",
    milestone: str = "2021-10-01",
) -> DataFrame:
    """Adults with a negative index, follow-up, and no sign of the condition.

    Eligibility is settled first, so only eligible persons' micro-visits are consolidated.
    """
    clear = persons.filter(
        (F.col("age") >= min_age) & (F.col("confirmed_case") == 0) & (F.col("possible_case") == 0)
    ).withColumn("index_date", F.col(index))
    df = attach_latest(clear, visits, "person_id", "visit_start_date", "latest_visit_date")
    df = eligible_followup(df, "latest_visit_date", "index_date", gap)
    df = exclude(df, cases)
    own_visits = micro_visits.join(df.select("person_id"), "person_id", "left_semi")
    history = visit_history(consolidate_visits(own_visits), df)
    df = df.join(history, "person_id", "left")
    df = in_set_flag(df, persons.filter(F.col(dx) == 1), site, "is_dx_site")
    return _with_rates(df.withColumn("milestone_date", F.lit(milestone).cast("date")), 0)


def flag_cohort(df: DataFrame, flags: Sequence[str], min_age: int = 18, age: str = "age") -> DataFrame:
    return df.filter(any_flag(flags) & (F.col(age) >= min_age))


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each step, the steps applied one after another, in a single pass.

    Gives (step, name, n), with step 0 the number of rows to start from.
    """
    passed = F.lit(True)
    counts, labels = [F.count("*").alias("n0")], ["all"]
    for i, (name, predicate) in enumerate(steps, start=1):
        passed = passed & F.coalesce(predicate, F.lit(False))
        counts.append(F.count(F.when(passed, 1)).alias(f"n{i}"))
        labels.append(name)
    rows = [
        F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"n{i}").alias("n"))
        for i, name in enumerate(labels)
    ]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def pre_match(
    cases: DataFrame,
    controls: DataFrame,
    origin: str = "2020-01-01",
    site: str = "site_id",
    period: str = "observation_period",
) -> DataFrame:
    """Cases and controls on shared columns, restricted to shared sites."""
    shared = ["person_id", period, site, "age", "index_date", "is_case", "log_visit_rate"]
    left, right = common_keys(controls.select(*shared), cases.select(*shared), site)
    return (
        left.unionByName(right)
        .withColumn("age", F.col("age").cast("int"))
        .withColumn("index_day", day_gap("index_date", F.to_date(F.lit(origin))))
    )


def matched_cases(cases: DataFrame, *matchings: DataFrame) -> DataFrame:
    """Cases that found a partner in every matching."""
    return intersect_keys(cases, *[m.filter(F.col("is_case") == 1) for m in matchings])


def matched_controls(matching: DataFrame, cases_kept: DataFrame) -> DataFrame:
    """Controls whose pair still has its case: pairs of exactly two rows once other cases are gone."""
    controls = matching.filter(F.col("is_case") == 0)
    kept = matching.filter(F.col("is_case") == 1).join(cases_kept.select("person_id"), "person_id", "left_semi")
    both = controls.unionByName(kept)
    return keep_groups_of_size(both, "subclass", 2).filter(F.col("is_case") == 0)


ARMS = ("case_arm", "positive_arm", "negative_arm")


def stack_arms(case: DataFrame, positive: DataFrame, negative: DataFrame) -> DataFrame:
    """(person, index date) of the three arms with one indicator column per arm."""
    def mark(df: DataFrame, arm: str) -> DataFrame:
        return df.select("person_id", "index_date", *[F.lit(int(a == arm)).alias(a) for a in ARMS])

    parts = [mark(df, arm) for df, arm in zip((case, positive, negative), ARMS)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def analysis_cohort(
    case: DataFrame,
    positive: DataFrame,
    negative: DataFrame,
    positive_facts: DataFrame,
    all_facts: DataFrame,
    comorbidity_positive: DataFrame,
    comorbidity_all: DataFrame,
    negative_history: DataFrame,
) -> DataFrame:
    """The three matched arms, enriched and harmonised, with gaps in obesity and visit rate filled."""
    from .features import fill_mean

    facts = ["person_id", "morbid_obesity", "vaccine_doses", "death"]
    spans = ["person_id", "observation_before", "visits_before"]
    stacked = stack_arms(case, positive, negative)
    with_index = (
        stacked.filter(F.col("negative_arm") == 0)
        .join(positive_facts.select(*facts, *spans[1:]), "person_id", "left")
        .join(comorbidity_positive.select("person_id", "comorbidity_score"), "person_id", "left")
    )
    without_index = (
        stacked.filter(F.col("negative_arm") == 1)
        .join(all_facts.select(*facts), "person_id", "left")
        .join(comorbidity_all.select("person_id", "comorbidity_score"), "person_id", "left")
        .join(negative_history.select(*spans), "person_id", "left")
    )
    df = with_index.unionByName(without_index).withColumns({
        "vaccine_doses": F.col("vaccine_doses").cast("int"),
        "morbid_obesity": F.coalesce("morbid_obesity", F.lit(0)),
        "visit_rate": safe_rate("visits_before", "observation_before"),
    })
    return fill_mean(df, ["visit_rate"])


def overlap(a: DataFrame, b: DataFrame, key: str = "person_id") -> DataFrame:
    """One row: how many keys the two frames share."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi").agg(F.count("*").alias("n"))


def disjoint_check(arms: dict[str, DataFrame], key: str = "person_id") -> DataFrame:
    """(pair, n) for every two arms; all zero where the arms are disjoint.

    One row per key and arm, then a bitmap per key: every pair is read off one shuffle.
    """
    names = list(arms)
    tagged = None
    for i, name in enumerate(names):
        part = arms[name].select(key, F.lit(1 << i).alias("_bit"))
        tagged = part if tagged is None else tagged.unionByName(part)
    bits = tagged.groupBy(key).agg(F.bit_or("_bit").alias("_bits"))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    masks = {f"{names[i]}|{names[j]}": (1 << i) | (1 << j) for i, j in pairs}
    counts = [
        F.count(F.when(F.col("_bits").bitwiseAND(F.lit(mask)) == mask, 1)).alias(f"n{k}")
        for k, mask in enumerate(masks.values())
    ]
    rows = [
        F.struct(F.lit(name).alias("pair"), F.col(f"n{k}").alias("n")) for k, name in enumerate(masks)
    ]
    return bits.agg(*counts).select(F.inline(F.array(*rows)))


def label_consistency(positive: DataFrame, persons: DataFrame) -> DataFrame:
    """Index-positive persons whom the person table calls neither confirmed nor possible."""
    odd = persons.filter((F.col("confirmed_case") == 0) & (F.col("possible_case") == 0))
    return odd.join(positive.select("person_id"), "person_id", "left_semi")


