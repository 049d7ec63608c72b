"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets. Queries, in blocks, first meet the bucket of the longest vectors,
which gives each a score that its k-th result will reach at least. From it follows a cosine that a vector of a
bucket must reach: over one, the bucket is passed over; otherwise the rows that are too short go, and, where one
coordinate alone rules out most of the rest, only what it leaves. Whatever is left is verified by its product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed


SCALE = 256
K = 5
EVERY = 50
BUCKET_ROWS = 2048
QUERY_ROWS = 1024
SALTS = 16
COORDINATE_SHARE = 0.1  # coordinate pruning pays if it leaves at most this share of a bucket
SLACK = 1e-6  # relative; floating-point bounds are loosened by it, products are exact


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q, dim, length) of the rows with an id and only finite components."""
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, finite)).select(
        F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"), F.size(x).alias("dim")).withColumn(
        "length", F.sqrt(F.aggregate("q", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))))


def _packed(rows: DataFrame, size: int, by_length: bool) -> DataFrame:
    """Blocks of up to ``size`` vectors of one dimension: block, dim, ids, matrix (int64), longest."""
    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary()), ("longest", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, list[int], float]]] = {}

        def pack(dim: int) -> pa.RecordBatch:
            part = held.pop(dim)
            return pa.RecordBatch.from_pydict({
                "dim": [dim], "ids": [np.array([p[0] for p in part], "<i8").tobytes()],
                "matrix": [np.array([p[1] for p in part], "<i8").tobytes()], "longest": [max(p[2] for p in part)]}, schema)

        for batch in batches:
            for vec_id, q, dim, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.setdefault(dim, []).append((vec_id, q, length))
                if len(held[dim]) == size:
                    yield pack(dim)
        for dim in list(held):
            yield pack(dim)

    order = [F.col("dim"), F.col("length").desc(), F.xxhash64("vec_id")] if by_length else [F.col("dim"), F.xxhash64("vec_id")]
    ranged = rows.select("vec_id", "q", "dim", "length").repartitionByRange(*order).sortWithinPartitions(*order)
    return checkpointed(ranged.mapInArrow(run, "dim int, ids binary, matrix binary, longest double").withColumn(
        "block", F.monotonically_increasing_id()))


def _best(ids: np.ndarray, scores: np.ndarray, own: np.ndarray, least: np.ndarray, k: int):
    """(query row, vector row) of each query's k best scores of at least ``least``, ties to smaller ids."""
    alive = (ids[None, :] != own[:, None]) & (scores >= least[:, None])
    worth = np.where(alive, scores, -np.inf) if scores.dtype != object else None
    if worth is not None and worth.shape[1] > k:
        kth = np.partition(worth, worth.shape[1] - k, axis=1)[:, -k]
        alive &= worth >= kth[:, None]
    at, column = np.nonzero(alive)
    order = sorted(range(len(at)), key=lambda i: (at[i], -scores[at[i], column[i]], ids[column[i]])) \
        if scores.dtype == object else np.lexsort((ids[column], -scores[at, column], at))
    at, column = at[order], column[order]
    place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
    return at[place < k], column[place < k]


def search_bucket(ids, matrix, lengths, q_ids, queries, q_lengths, least, k: int):
    """(query row, vector row, score) of what a bucket can add for a block of queries."""
    bound = float(lengths.max(initial=0) * q_lengths.max(initial=0))
    kind = np.float32 if bound < 1 << 23 else np.float64 if bound < 1 << 52 else object
    m, q = matrix.astype(kind), queries.astype(kind)
    parts = []
    with np.errstate(divide="ignore", invalid="ignore"):
        needed = least / (q_lengths * lengths.max(initial=0))  # the local cosine threshold
    loose = np.where(needed > 0, needed * (1 - SLACK), -1.0)
    open_ = np.flatnonzero(~(loose > 1))
    unit = matrix / np.maximum(lengths, 1e-300)[:, None]
    sorted_by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    plain = []
    for i in open_.tolist():
        t = loose[i]
        if t <= 0.3 or kind is object:
            plain.append(i)
            continue
        f = int(np.argmax(np.abs(queries[i])))
        if f not in sorted_by:
            order = np.argsort(unit[:, f])
            sorted_by[f] = order, unit[order, f]
        order, values = sorted_by[f]
        c = queries[i, f] / q_lengths[i]
        spread = np.sqrt(max(0.0, (1 - t * t) * (1 - c * c))) + SLACK
        low = c * t - spread if c * t - spread > -1 and -c < t else -1.0
        high = 1.0 if c >= t else c * t + spread
        a, b = np.searchsorted(values, low - SLACK, "left"), np.searchsorted(values, high + SLACK, "right")
        if b - a > COORDINATE_SHARE * len(values):
            plain.append(i)
        elif b > a:
            rows = order[a:b]
            s = (m[rows] @ q[i])[None, :]
            at, column = _best(ids[rows], s, q_ids[i:i + 1], least[i:i + 1], k)
            parts.append((np.full(len(at), i), rows[column], s[0, column]))
    if plain:
        plain = np.array(plain)
        shortest = np.min(least[plain] * (1 - SLACK) / np.maximum(q_lengths[plain], 1e-300), initial=np.inf)
        rows = np.flatnonzero(lengths >= shortest) if shortest > 0 else np.arange(len(ids))
        if len(rows):
            s = q[plain] @ m[rows].T
            at, column = _best(ids[rows], s, q_ids[plain], least[plain], k)
            parts.append((plain[at], rows[column], s[at, column]))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), []
    row, column = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
    limit = 2**63 - 1
    return row, column, [max(-limit - 1, min(limit, int(v))) for p in parts for v in p[2]]


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """(q_block, q_row, query_id, vec_id, score) from pairs of a bucket and a query block."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame.itertuples():
                ids, q_ids = np.frombuffer(p.ids, "<i8"), np.frombuffer(p.q_ids, "<i8")
                matrix = np.frombuffer(p.matrix, "<i8").reshape(len(ids), p.dim)
                queries = np.frombuffer(p.q_matrix, "<i8").reshape(len(q_ids), p.dim)
                lengths, q_lengths = (np.sqrt((x.astype(float) ** 2).sum(1)) for x in (matrix, queries))
                least = np.frombuffer(p.least, "<f8") if p.least else np.full(len(q_ids), -np.inf)
                row, column, score = search_bucket(ids, matrix, lengths, q_ids, queries, q_lengths, least, k)
                yield pd.DataFrame({"q_block": p.q_block, "q_row": row, "query_id": q_ids[row], "vec_id": ids[column],
                                    "score": pd.array(score, "int64")})

    return pairs.select("dim", "ids", "matrix", "q_block", "q_ids", "q_matrix", "least").mapInPandas(
        run, "q_block long, q_row long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row whose vec_id is divisible by ``every``.

    Rows with a null vec_id, a null vector, or a null or non-finite component take no part. Vectors are
    compared with those of as many components only. Rows with a query's vec_id are its own; equal queries
    are asked once, and queries that share an id but not a vector are ranked apart. Repeated candidate rows
    are candidates each. Scores are exact while they fit 64 bits, and stop at the limits of a long.
    """
    rows = checkpointed(quantised(vectors, scale))
    buckets = _packed(rows, BUCKET_ROWS, True)
    queries = _packed(rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "q"]), QUERY_ROWS, False).select(
        F.col("block").alias("q_block"), "dim", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    longest = buckets.groupBy("dim").agg(F.max_by("block", F.struct("longest", (-F.col("block")).alias("b"))).alias("block"))
    seeds = buckets.join(longest.select("block"), "block").drop("block", "longest")
    started = _searched(queries.join(seeds, "dim").withColumn("least", F.lit(None).cast("binary")), k)
    reached = started.groupBy("q_block", "q_row").agg(F.count("*").alias("n"), F.min("score").alias("score")).groupBy("q_block").agg(
        F.map_from_entries(F.collect_list(F.struct("q_row", F.when(F.col("n") >= k, F.col("score"))))).alias("reached"))

    def lows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"q_block": frame["q_block"], "dim": frame["dim"], "q_ids": frame["q_ids"], "q_matrix": frame["q_matrix"], "least": [
                np.array([-np.inf if not r or r.get(i) is None else r[i] for i in range(len(ids) // 8)], "<f8").tobytes()
                for ids, r in zip(frame["q_ids"], frame["reached"], strict=True)]})

    asked = checkpointed(queries.join(reached, "q_block", "left").mapInPandas(
        lows, "q_block long, dim int, q_ids binary, q_matrix binary, least binary"))
    # Every block of queries meets every bucket of its dimension; salts spread a dimension over tasks.
    salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keys = buckets.select("block", "dim", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int").alias("salt"))
    pairs = salted.join(keys, ["dim", "salt"]).drop("dim").join(buckets, "block")
    found = _searched(pairs, k)
    best = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
