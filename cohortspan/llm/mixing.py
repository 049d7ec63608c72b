"""Mixing sources to target weights by weighted fair queueing.

Every source deals out its shuffled documents, and then deals them out again, one copy at most per pass.
A copy's virtual finish time is the words its source has dealt so far divided by the source's target.
The mix is the start of the global order by finish time, up to the budget.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_bits, checkpointed, numbered, repeated, running_total, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix"
CUTS = 4096  # intervals of virtual time per search step
TAIL_ROWS = 100_000  # an interval with at most so many copies is put in order exactly


def source_targets(units: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """(source, rank, source_size, target) from (source, size).

    Sources in code-point order, null last, take the weights in turn. They share ``share`` times all
    words; a target stops at ``most`` times its source's size and the excess is shared again by weight.
    """
    totals = checkpointed(units.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = totals.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    schema = T.StructType([*totals.schema.fields, T.StructField("rank", T.LongType())])
    sources = checkpointed(units.sparkSession.createDataFrame(ranked, schema).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ).withColumn("limit", F.col("source_size") * float(most)))
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # the level only rises, so sources only ever join the full ones
        above = F.col("weight") * level > F.col("limit")
        held, open_weight, n = sources.agg(
            F.sum(F.when(above, F.col("limit")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))),
            F.sum(above.cast("long"))).first()
        if not open_weight or n == full:
            break
        full, level = n, (budget - held) / open_weight
    return sources.select("source", "rank", "source_size", F.least("limit", F.col("weight") * level).alias("target"))


def _row(docs: DataFrame):
    """A hash of all of a row. Together with the doc_id it stands for the rows that are equal throughout."""
    plain = [c if "map<" not in t and "variant" not in t else F.to_json(F.struct(c)) for c, t in docs.dtypes]
    return F.xxhash64(*plain)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST,
        seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, whole copies of the document).

    A null or empty text has size 0 and is never taken. A null source is a source of its own, and a null
    doc_id is an id like any other. Repeated rows and rows that share a doc_id are documents of their own. Copies are
    taken in the order of (finish time, source, shuffle key), so that reruns agree; all of the mix's copies fit the budget.
    """
    return _mix(docs, weights, share, most, seed).select("doc_id", "size", "source_size", "target", "taken")


def _mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    # The shuffle key is a hash of id, row and number among equal rows: no id and no row, however often it
    # comes, sits in one bucket of the running totals.
    units = checkpointed(numbered(docs.select(
        "doc_id", "source", word_count("text").alias("size"), _row(docs).alias("row"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"))).withColumn(
        "h", F.xxhash64(F.lit(seed), "doc_id", "row", "at")))
    goals = checkpointed(source_targets(units, weights, share, most).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "rank", "source_size", "target"))
    dealt = running_total(units, ["key"], ["h", "doc_id", "row", "at"], "size", "through", bucket_bits(units.count()))
    passes = range(math.ceil(most))
    queue = checkpointed(dealt.join(goals, "key").select(
        "doc_id", "row", "size", "h", "rank", "source_size", "target", *[
            F.coalesce(F.try_divide(F.col("through") + F.col("source_size") * i, F.col("through") + F.col("source_size") * i
                                    + F.col("target")), F.lit(0.0)).alias(f"finish{i}") for i in passes]))
    budget = share * (goals.agg(F.sum("source_size")).first()[0] or 0)
    last = _last_copy(queue, passes, budget)
    if last is None:
        taken = F.lit(0)
    else:
        limit = F.struct(*[F.lit(x).alias(name) for x, name in zip(last, ("finish", "rank", "h", "pass"), strict=True)])
        taken = sum(F.when(_order(i) <= limit, F.col("size")).otherwise(0) for i in passes)
    return queue.select("doc_id", "row", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _order(i: int):
    return F.struct(F.col(f"finish{i}").alias("finish"), "rank", "h", F.lit(i).cast("long").alias("pass"))


def _last_copy(queue: DataFrame, passes: range, budget: float):
    """The last copy, in mix order, of those that fit the budget together; None if none does.

    Finish times v are kept as v / (1 + v). The interval that holds the cut is narrowed step by step from
    sums per interval, until what it holds can be sorted.
    """
    copies = queue.filter("size > 0").select("size", F.explode(F.array(*[_order(i) for i in passes])).alias("at")).select(
        "size", "at.*")
    low, high, before, total = 0.0, 1.0, 0, 0
    while True:
        inside = copies.filter((F.col("finish") >= low) & (F.col("finish") <= high))
        width = (high - low) / CUTS
        place = F.floor((F.col("finish") - low) / width) if width > 0 else F.lit(0)
        sums = inside.groupBy(place.alias("place")).agg(
            F.sum("size"), F.count("*"), F.min("finish"), F.max("finish")).orderBy("place").collect()
        crossed = None
        for _, size, n, least, greatest in sums:
            total = before + size
            if total > budget:
                crossed = (n, least, greatest)
                break
            before = total
        if crossed is None:
            inside_last = (sums[-1][3], sums[-1][4]) if sums else None
            if inside_last is None:
                return None
            low, high = inside_last
            break
        n, low, high = crossed
        if n <= TAIL_ROWS or low == high:
            break
    done = copies.filter(F.col("finish") < low).agg(F.sum("size")).first()[0] or 0
    tail = copies.filter((F.col("finish") >= low) & (F.col("finish") <= high)).withColumn(
        "so_far", F.sum("size").over(Window.orderBy("finish", "rank", "h", "pass")))
    last = tail.filter(F.col("so_far") <= budget - done).agg(F.max(F.struct("finish", "rank", "h", "pass"))).first()[0]
    if last is None:
        last = copies.filter(F.col("finish") < low).agg(F.max(F.struct("finish", "rank", "h", "pass"))).first()[0]
    return None if last is None else tuple(last)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every row as often as the mix takes it. Equal rows share what the mix takes of them together."""
    wanted = checkpointed(_mix(docs, **how).groupBy("doc_id", "row").agg(
        F.sum(F.when(F.col("taken") > 0, F.col("taken") / F.col("size")).otherwise(0)).cast("long").alias("_times"),
        F.count("*").alias("_rows")).filter("_times > 0").withColumnsRenamed({"doc_id": "_doc_id", "row": "_row"}))
    held = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("_id"), _row(docs).alias("_hash")).join(
        wanted, F.col("_id").eqNullSafe(F.col("_doc_id")) & (F.col("_hash") == F.col("_row")))
    rows = held.select("_doc", "_times", "_rows")
    if not wanted.filter("_rows > 1").isEmpty():
        once = held.filter("_rows > 1").groupBy("_doc_id", "_row").agg(
            F.first("_doc").alias("_doc"), F.first("_times").alias("_times"), F.first("_rows").alias("_rows"))
        rows = rows.filter("_rows = 1").unionByName(once.select(*rows.columns))
    return repeated(rows, "_times", "_copy").select("_doc.*")
