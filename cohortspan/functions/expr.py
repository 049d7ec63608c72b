"""Column expressions shared by the operators. All stay inside generated code on the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_gap(end: str | Column, start: str | Column) -> Column:
    return F.datediff(col(end), col(start))


def min_gap_days(end: str | Column, start: str | Column, days: int) -> Column:
    """True where ``end`` lies at least ``days`` after ``start``."""
    return day_gap(end, start) >= days


def any_flag(columns: Iterable[str]) -> Column:
    """At least one indicator equals 1; a null indicator counts as not set."""
    return reduce(lambda a, b: a | b, [F.col(c).eqNullSafe(1) for c in columns])


def safe_rate(n: str | Column, period: str | Column, per: float = 30.0) -> Column:
    """``per * n / period``; null for an empty period instead of an ANSI error."""
    return F.try_divide(F.lit(float(per)) * col(n), col(period).cast("double"))


def log_rate(n: str | Column, period: str | Column, per: float = 30.0) -> Column:
    """Log of the rate, 0 where there is no rate (so no rate reads like a rate of one)."""
    return F.coalesce(F.log(safe_rate(n, period, per)), F.lit(0.0))


def indicator(predicate: Column) -> Column:
    """1 where the predicate holds, else 0 (null counts as not)."""
    return F.when(predicate, 1).otherwise(0)


def recode(c: str | Column, mapping: Mapping[str, str], default: str) -> Column:
    """Relabel listed values; everything else, null included, becomes ``default``."""
    out = reduce(lambda acc, kv: acc.when(col(c) == kv[0], kv[1]), mapping.items(), F)
    return out.otherwise(default)


def is_value(c: str | Column, value: str) -> Column:
    return indicator(col(c) == value)


def in_levels(c: str | Column, levels: Sequence[str]) -> Column:
    return indicator(col(c).isin(list(levels)))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part * F.lit(100.0), whole.cast("double")), digits)


def number_text(c: str | Column, missing: str) -> Column:
    return F.coalesce(col(c).cast("double").cast("string"), F.lit(missing))


def clamp(c: str | Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def hash_unit(*parts: str | Column) -> Column:
    """52 bits of the md5 of the joined parts, as a long: a partition-independent random draw."""
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def strip_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """Remove ``suffix`` from every column name that contains it."""
    return df.withColumnsRenamed({c: c.replace(suffix, "") for c in df.columns if suffix in c})


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column."""
    doubles = [name for name, dtype in df.dtypes if dtype == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})
