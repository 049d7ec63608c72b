"""Descriptive tables: cohort summary, category shares, correlations, odds-ratio table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import number_text, percent, recode
from .features import AGE_BUCKETS, bucket_predicate

# Labels of the summary rows and the reporting names of race/ethnicity levels.
AGE_LABELS = (
    "1.Age less than 1 (in %)",
    "2.Age between 1 to 4 (in %)",
    "3.Age between 5 to 9 (in %)",
    "4.Age between 10 to 15 (in %)",
    "5.Age between 16 to 20 (in %)",
    "6.Age between 21 to 45 (in %)",
    "7.Age between 46 to 65 (in %)",
    "8.Age higher than 66 (in %)",
)
AGE_MISSING_LABEL = "9.Age missing (in %)"
RACE_REPORT_NAMES = {
    "White Non-Hispanic": "Non-Hispanic White",
    "Black or African American Non-Hispanic": "Non-Hispanic Black",
    "Hispanic or Latino Any Race": "Hispanic",
    "Asian Non-Hispanic": "Non-Hispanic Asian",
    "Unknown": "Missing/Unknown",
}
RACE_REPORT_DEFAULT = "Non-Hispanic Other"


def category_share(df: DataFrame, c: str) -> DataFrame:
    """Count and percent of the total per category, largest first."""
    counts = df.groupBy(c).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent_of_total", percent(F.col("n"), total)).orderBy(F.desc("n"), c)


def cohort_summary(
    df: DataFrame,
    age: str = "age",
    race: str = "race_ethnicity",
    sex: str = "sex",
    race_names: Mapping[str, str] = RACE_REPORT_NAMES,
    race_default: str = RACE_REPORT_DEFAULT,
    stat_digits: int | None = None,
) -> DataFrame:
    """Table 1 of a cohort: (value_name, percent_value, count_value, count_percent), by name.

    Grouping sets give the age aggregates and both category blocks from one scan and one shuffle.
    Kept as in the source tables: the first bucket's percent has no decimals, the bucket "higher
    than 66" includes 66, fractional ages between buckets count nowhere, and the mean and standard
    deviation rows have no count.
    """
    race_label = recode(race, race_names, race_default).alias("_race")
    buckets = [bucket_predicate("_age", low, high, closed_top=True) for _, low, high in AGE_BUCKETS]
    src = df.select(F.col(age).alias("_age"), race_label, F.col(sex).alias("_sex"))
    agg = src.groupingSets([["_race"], ["_sex"], []], "_race", "_sex").agg(
        F.grouping_id().alias("_set"),
        F.count("*").alias("_n"),
        F.count(F.when(F.col("_age").isNull(), 1)).alias("_missing"),
        F.avg("_age").alias("_mean"),
        F.stddev_samp("_age").alias("_std"),
        *[F.count(F.when(p, 1)).alias(f"_b{i}") for i, p in enumerate(buckets)],
    )
    # The window runs over one row per category, never over persons.
    agg = agg.withColumn("_total", F.max(F.when(F.col("_set") == 3, F.col("_n"))).over(W.partitionBy()))
    total = F.col("_total")

    def row(name, pct, n):
        return F.struct(name.alias("value_name"), pct.cast("double").alias("percent_value"),
                        n.cast("bigint").alias("count_value"))

    def stat(c):
        return F.round(c, stat_digits) if stat_digits is not None else F.col(c)

    age_rows = [
        row(F.lit(label), percent(F.col(f"_b{i}"), total, 0 if i == 0 else 2), F.col(f"_b{i}"))
        for i, label in enumerate(AGE_LABELS)
    ]
    age_rows.append(row(F.lit(AGE_MISSING_LABEL), percent(F.col("_missing"), total), F.col("_missing")))
    age_rows.append(row(F.lit("mean_age"), stat("_mean"), F.lit(None)))
    age_rows.append(row(F.lit("std_age"), stat("_std"), F.lit(None)))

    def category(prefix, c):
        label = F.concat(F.lit(prefix), F.coalesce(F.col(c), F.lit("None")))
        return F.array(row(label, percent(F.col("_n"), total), F.col("_n")))

    rows = (
        F.when(F.col("_set") == 3, F.array(*age_rows))
        .when(F.col("_set") == 1, category("Race_Ethnicity_", "_race"))
        .otherwise(category("Sex_", "_sex"))
    )
    return (
        agg.select(F.inline(rows))
        .withColumn("count_percent", F.concat(
            number_text("count_value", "nan"), F.lit("("), number_text("percent_value", "nan"), F.lit("%)")
        ))
        .orderBy("value_name")
    )


def corr_matrix(df: DataFrame, columns: Sequence[str], triangle: bool = False) -> DataFrame:
    """Pearson correlations (row_name, col_name, r) on pairwise complete rows, in one aggregate.

    A constant column gives null rather than a division error. With ``triangle`` only the part
    below the diagonal is returned.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    aggs = []
    for i, j in pairs:
        a, b = F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")
        a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
        r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
        aggs.append(r.alias(f"r_{i}_{j}"))
    rows = []
    for i, j in pairs:
        if triangle and i == j:
            continue
        cells = [(i, j)] if triangle or i == j else [(i, j), (j, i)]
        rows += [
            F.struct(F.lit(columns[p]).alias("row_name"), F.lit(columns[q]).alias("col_name"),
                     F.col(f"r_{i}_{j}").alias("r"))
            for p, q in cells
        ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def odds_ratio_table(glm_table: DataFrame, max_high: float | None = None, alpha: float = 0.05) -> DataFrame:
    """What a forest plot draws: estimate, interval, p value and a significance label.

    ``max_high`` keeps rows whose upper bound is known and not above it.
    """
    df = glm_table if max_high is None else glm_table.filter(F.col("conf_high") <= max_high)
    label = F.when(F.col("p_value") < alpha, "Significant").when(F.col("p_value").isNotNull(), "Non-Significant")
    return df.drop("statistic", "std_error").withColumn("significance", label)
