"""Running totals over a total order, without ever putting a large group into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import checkpointed, parts_for


def prefix_sum(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[tuple[str, bool]],
    sums: Mapping[str, str],
    rows_per_part: int = 200_000,
    materialised: bool = False,
) -> DataFrame:
    """Add inclusive running sums ``{out: column}`` per ``group`` in ``order`` [(column, ascending)].

    Up to ``rows_per_part`` rows a plain window does. Beyond it the rows are range-partitioned by
    group and order, so that a hot group is spread over many parts; sums inside each part are then
    shifted by what lies in the parts before it. Rows must be unique in (group, order). Pass
    ``materialised`` when ``df`` reads a written table.
    """
    df = df if materialised else checkpointed(df)
    n = df.count()
    keys = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    frame = (W.unboundedPreceding, 0)
    if n <= rows_per_part:
        over = W.partitionBy(*group).orderBy(*keys).rowsBetween(*frame)
        return df.withColumns({out: F.sum(c).over(over) for out, c in sums.items()})

    parts = parts_for(n, rows_per_part)
    spread = checkpointed(
        df.repartitionByRange(parts, *[F.col(g) for g in group], *keys).withColumn("_part", F.spark_partition_id())
    )
    inside = W.partitionBy("_part", *group).orderBy(*keys).rowsBetween(*frame)
    # One row per part and group met there: parts + groups - 1 rows at most.
    totals = spread.groupBy("_part", *group).agg(*[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_part", *group, *[
        F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in sums
    ])
    return (
        spread.withColumns({out: F.sum(c).over(inside) for out, c in sums.items()})
        .join(offsets, ["_part", *group])
        .withColumns({out: F.col(out) + F.col(f"_o_{out}") for out in sums})
        .drop("_part", *[f"_o_{out}" for out in sums])
    )


def with_totals(df: DataFrame, source: DataFrame, by: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Attach per-``by`` aggregates of ``source`` to ``df``; one scalar subquery where ``by`` is empty."""
    aggs = [c.alias(name) for name, c in totals.items()]
    if by:
        return df.join(source.groupBy(*by).agg(*aggs), list(by))
    one = source.agg(F.struct(*aggs).alias("_totals")).scalar()
    return df.withColumn("_totals", one).select("*", "_totals.*").drop("_totals")
