"""What several corpus operators share: texts as bytes, word hashes, running totals, connected components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import runtime

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Words (runs without ASCII white space) of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


BATCH_ROWS = 256
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BEFORE = "cohortspan.recordsPerBatch"  # what the session had there


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` over rows that hold whole texts: at most ``BATCH_ROWS`` of them at once.

    Spark's own batches are 10,000 rows, which long texts make too large for a worker. The batch size has no
    other place than the session's setting; it is lowered until the next ``checkpointed`` has run the plan.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCHES)) <= BATCH_ROWS:
        conf.set(_BEFORE, conf.get(_BATCHES))
        conf.set(_BATCHES, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; the session has its own batch size again."""
    out = runtime.checkpointed(df)
    restore_batches(df.sparkSession)
    return out


def restore_batches(spark: SparkSession) -> None:
    before = spark.conf.get(_BEFORE, None)
    if before:
        spark.conf.set(_BATCHES, before)
        spark.conf.unset(_BEFORE)


def map_texts(df: DataFrame, fn: Callable[[list, list[bytes]], dict[str, list]], schema: str,
              id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Apply ``fn(ids, texts)`` to batches of (id, whole text); null texts arrive as empty.

    Batches are cut again so that a few very long texts never sit in one call together.
    """
    arrow_schema = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _slices(batch):
                yield pa.RecordBatch.from_pydict(fn(ids, texts), schema=arrow_schema)

    return map_batches(df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _slices(batch: pa.RecordBatch, rows: int = 512, limit: int = 4_000_000) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, held = [], [], 0
    for start in range(0, batch.num_rows, rows):
        part = batch.slice(start, rows)
        for i, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
            ids.append(i)
            texts.append(text or b"")
            held += len(texts[-1])
            if held >= limit:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts
            ids, texts, held = [], [], 0


def hash_words(words: Sequence[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))


def flatten(word_lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in one array, the text number of each word, and each text's first position."""
    counts = np.fromiter(map(len, word_lists), np.int64, len(word_lists))
    hashes = hash_words([w for words in word_lists for w in words])
    starts = np.concatenate(([0], np.cumsum(counts)))
    return hashes, np.repeat(np.arange(len(word_lists)), counts), starts


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (public splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}
FILTER_BITS = 1 << 23  # size of a bit table of hashes, whatever goes into it


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), np.uint64(base), np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


class RollingHash:
    """Hashes of runs of words from a polynomial modulo 2**64 over their word hashes.

    With ``second`` another, independent one: both together are a 128-bit key.
    """

    def __init__(self, hashes: np.ndarray, second: bool = False):
        self.hashes = hashes
        self.base = 0xC2B2AE3D27D4EB4F if second else 0x9E3779B97F4A7C15
        own = mixed(hashes ^ np.uint64(self.base)) if second else hashes
        self.sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own * _powers(self.base, len(own)), dtype=np.uint64, out=self.sums[1:])

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = _powers(pow(self.base, -1, 1 << 64), len(self.sums))
        return mixed((self.sums[end] - self.sums[begin]) * down[begin] + (end - begin).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        begin = np.arange(max(0, len(self.hashes) - k + 1))
        return self.spans(begin, begin + k)


def bit_table(hashes: DataFrame) -> bytes:
    """A table of FILTER_BITS bits with the low bits of every hash ``h`` set, or-ed together by Spark.

    Its size does not grow with the input. What it lets through is joined exactly afterwards.
    """
    place = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = hashes.select(
        F.shiftright(place, 6).alias("row"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")
    ).groupBy("row").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(FILTER_BITS // 64, "<i8")
    for row, bits in rows.collect():
        table[row] = bits
    return table.tobytes()


def passes(hashes: np.ndarray, table: bytes) -> np.ndarray:
    place = hashes & np.uint64(FILTER_BITS - 1)
    bits = np.frombuffer(table, np.uint8)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def sliding_argmin(values: np.ndarray, window: int) -> np.ndarray:
    """Position of the rightmost minimum in each run of ``window`` values, by doubling."""
    n = len(values) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = np.arange(len(values))
    width = 1
    while width < window:
        step = min(width, window - width)
        left, right = best[:-step], best[step:]
        best = np.where(values[right] <= values[left], right, left)
        width += step
    return best[:n]


def bucket_bits(n_rows: int, rows: int = 256, most: int = 16) -> int:
    return max(0, min(most, math.ceil(math.log2(max(1, n_rows / rows)))))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, bits: int) -> DataFrame:
    """Add the running total of ``value`` within ``keys`` (no nulls there) in the order of ``order``.

    ``order[0]`` is a 64-bit hash. Its top ``bits`` split every key, so that no key, however hot, is
    sorted in one task: bucket sums give each bucket its base, and only a bucket is sorted.
    """
    split = df.withColumn("_bucket", F.shiftright(F.col(order[0]), 64 - bits) if bits else F.lit(0).cast("long"))
    by = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = split.groupBy(*by).agg(F.sum(value).alias("_sum")).select(
        *by, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return split.join(bases, by).withColumn(out, F.col("_base") + F.sum(value).over(within)).drop("_bucket", "_base")


def repeated(df: DataFrame, times: str, out: str, block: int = 1024) -> DataFrame:
    """Every row ``times`` times, numbered from 0 in ``out``.

    A row wanted more than ``block`` times is dealt out to other tasks in blocks first, so that no task writes all
    copies of it and no array of all their numbers exists.
    """
    n = F.col(times)
    often = df.filter(n > block).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block))))
    spread = often.repartition("_block", times).unionByName(df.filter(n <= block).withColumn("_block", F.lit(0).cast("long")))
    start = F.col("_block") * block
    return spread.withColumn(out, F.explode(F.sequence(start, F.least(n, start + block) - 1))).drop("_block")


def numbered(df: DataFrame, out: str = "at") -> DataFrame:
    """``df`` with the rows that are equal in all columns numbered from 0; they are counted, not sorted."""
    counted = checkpointed(df.groupBy(*df.columns).agg(F.count("*").alias("_times")))
    return repeated(counted.filter("_times > 0"), "_times", out).drop("_times")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the component's smallest node.

    Alternates the large-star and small-star steps until the edges are stars. A step is one combinable
    minimum and one join, written to the shared folder.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def linked(e: DataFrame) -> tuple[DataFrame, DataFrame]:
        least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return e, least

    def large(e: DataFrame) -> DataFrame:
        sym, least = linked(both(e))
        return sym.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        down, least = linked(down)
        tied = down.join(least, "u")
        return tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))

    def tidy(e: DataFrame) -> DataFrame:
        return checkpointed(e.filter("a <> b").distinct())

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    state = tidy(edges.select("a", "b"))
    seen = mark(state)
    while True:
        state = tidy(small(tidy(large(state))))
        now = mark(state)
        if now == seen:
            break
        seen = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
