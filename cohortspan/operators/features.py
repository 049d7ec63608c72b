"""Feature construction: buckets, one-hot columns, imputation, the wide feature table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import col, day_gap, in_levels, indicator, is_value, strip_suffix

# Inclusive age ranges; the last bucket is open above its bound.
AGE_BUCKETS = (
    ("lt1", None, 1),
    ("1to4", 1, 4),
    ("5to9", 5, 9),
    ("10to15", 10, 15),
    ("16to20", 16, 20),
    ("21to45", 21, 45),
    ("46to65", 46, 65),
    ("gt66", 66, None),
)


def bucket_predicate(age: str | Column, low: int | None, high: int | None, closed_top: bool = False) -> Column:
    a = col(age)
    if low is None:
        return a < high
    if high is None:
        return a >= low if closed_top else a > low
    return a.between(low, high)


def bucket_flags(df: DataFrame, age: str = "age") -> DataFrame:
    """Eight age indicators. Age exactly 66 belongs to none of them."""
    return df.withColumns({
        f"age_{name}": indicator(bucket_predicate(age, low, high)) for name, low, high in AGE_BUCKETS
    })


def age_groups(df: DataFrame, age: str = "age", top: int = 66) -> DataFrame:
    """Three indicators for models: 0-45, 46-65 and strictly above ``top``."""
    return df.withColumns({
        "age_under45": indicator(F.col(age).between(0, 45)),
        "age_46to65": indicator(F.col(age).between(46, 65)),
        "age_66plus": indicator(F.col(age) > top),
    })


def one_hot(df: DataFrame, c: str, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """One indicator per entry; several source levels may share one. Null gives zeros throughout."""
    return df.withColumns({name: in_levels(c, values) for name, values in levels.items()})


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace nulls by the column mean, as doubles. All means come from one scalar subquery."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("means")).scalar()
    return df.withColumn("_means", means).withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.col("_means").getField(c)) for c in columns
    }).drop("_means")


def mean_impute(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean-fill every given column (by default every numeric one) from a single aggregate."""
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    return fill_mean(df, list(columns) if columns else [c for c, t in df.dtypes if t in numeric])


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def features_except(df: DataFrame, *labels: str) -> list[str]:
    return [c for c in df.columns if c not in labels]


def feature_table(
    cohort: DataFrame,
    indicators: Sequence[str],
    carried: Sequence[str],
    label: str,
    race_levels: Mapping[str, Sequence[str]],
    key: str | None = "person_id",
    age: str = "age",
    sex: str = "sex",
    male: str = "MALE",
    race: str = "race_ethnicity",
    suffix: str = "",
) -> DataFrame:
    """Wide numeric table: indicators, carried columns, race, age group and sex flags, label.

    No comorbidity score is joined: none of its columns would survive, and the lookup is unique
    per person, so the join could not change the rows.
    """
    keep = [key] if key else []
    df = cohort.select(*keep, race, sex, age, *indicators, *carried, label)
    if suffix:
        df = strip_suffix(df, suffix)
    df = age_groups(one_hot(df, race, race_levels), age)
    return df.withColumn("male", is_value(sex, male)).drop(race, sex, age)


def survival_target(
    df: DataFrame,
    deaths: DataFrame,
    cutoff: str,
    key: str = "person_id",
    index_date: str = "index_date",
    event: str = "death",
) -> DataFrame:
    """Days from index to death, or to the cutoff for survivors; negative or unknown ones leave.

    Several death records of one person are reduced to the earliest, so rows are never multiplied.
    """
    earliest = deaths.groupBy(key).agg(F.min("death_date").alias("death_date"))
    end = F.when(F.col(event) == 1, F.col("death_date")).otherwise(F.to_date(F.lit(cutoff)))
    return (
        df.join(earliest, key, "left")
        .withColumn("duration", day_gap(end, index_date))
        .filter(F.col("duration") >= 0)
    )
