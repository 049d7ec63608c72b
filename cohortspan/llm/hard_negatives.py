"""Hard negatives by an inverted multi-index.

Vectors are halved, and each half has a codebook; a pair of codes is a cell. For an anchor, a half's score with a
code is at most its product with the code's centre plus its length times the code's radius, and a cell's score at
most the sum over both halves. A heap visits an anchor's cells in falling order of that sum (the multi-sequence
algorithm) and stops as soon as what was found is certified: first the anchor's positives, then the window below
each positive's score. The codebooks steer the order only; every row is in a cell and results are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, checkpointed, mixed

SCALE = 256
EVERY = 100  # anchors are the rows with a vec_id divisible by it
RELABEL = 7  # rows whose vec_id is divisible by it take the next label
CLASSES = 10
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100  # percent of a positive's score between which a negative's lies
CODES = 32  # of a half, at most
CELL_ROWS = 16  # rows a cell would hold if all were alike; fewer rows have fewer codes
BLOCK_ROWS = 4096  # rows of small cells, or of a part of a large one, that travel together
ANCHOR_ROWS = 256  # anchors asked together
PROBE_ROWS = 2048  # an anchor's first visit ends when its cells hold so many rows
SAMPLE_ROWS = 20_000  # the codebooks are fitted on about so many rows; results do not depend on them
SLACK = 1e-6  # relative; floating-point bounds are loosened by it, scores are exact integers


def eligible(vectors: DataFrame, scale: int = SCALE, relabel: int = RELABEL, classes: int = CLASSES,
             most: int = max(POSITIVES, NEGATIVES)) -> DataFrame:
    """(vec_id, label, q, dim) of the rows that take part; of equal rows as many as a result can hold."""
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    rows = vectors.filter(vec_id.isNotNull() & label.isNotNull() & x.isNotNull() & F.forall(x, finite)).select(
        vec_id.alias("vec_id"), F.when(F.pmod(vec_id, F.lit(relabel)) == 0, (label + 1) % classes).otherwise(label).alias("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("q"), F.size(x).alias("dim"))
    again = F.sequence(F.lit(1), F.least(F.col("n"), F.lit(most)).cast("int"))
    return rows.groupBy("vec_id", "label", "q", "dim").agg(F.count("*").alias("n")).withColumn("n", F.explode(again)).drop("n")


def _kmeans(points: np.ndarray, codes: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[np.sort(rng.permutation(len(points))[:codes])].astype(float)
    for _ in range(rounds):
        near = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1)[None] - 2 * points @ centres.T, axis=1)


@dataclass
class Index:
    """What an anchor needs to know of the cells of one dimension."""

    centres: tuple[np.ndarray, np.ndarray]  # codes of both halves
    radii: tuple[np.ndarray, np.ndarray] = ()  # farthest row of each code
    rows: np.ndarray = None  # rows by cell
    group: np.ndarray = None  # the cells that share blocks of rows
    parts: np.ndarray = None  # blocks that a group is dealt over

    def halves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.centres[0].shape[1]
        return q[:, :cut].astype(float), q[:, cut:].astype(float)

    def bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of an anchor's half-scores, by code."""
        out = []
        for half, centres, radii in zip(self.halves(anchor[None]), self.centres, self.radii, strict=True):
            exact = centres @ half[0]
            size = np.sqrt((half * half).sum())
            out.append(exact + size * radii + SLACK * size * (np.sqrt((centres * centres).sum(1)) + radii))
        return tuple(out)

    def gather(self, block_rows: int) -> None:
        """Deal small neighbouring cells into one group, large cells over several blocks."""
        self.group, groups, held = np.zeros(len(self.rows), np.int64), [], 0
        for cell, n in enumerate(self.rows.tolist()):
            if not groups or held + n > block_rows:
                groups.append(0)
                held = 0
            held += n
            self.group[cell] = len(groups) - 1
            groups[-1] = held
        self.parts = np.maximum(1, -(-np.array(groups, np.int64) // block_rows))


def visit(bounds: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> Iterator[tuple[float, int]]:
    """(bound, cell) of the cells that hold rows, in falling order of the bound, by the multi-sequence algorithm."""
    first, second = (np.argsort(-b, kind="stable").tolist() for b in bounds)
    one, two = ([float(b[c]) for c in order] for b, order in zip(bounds, (first, second), strict=True))
    filled = rows.tolist()
    heap, n = [(-(one[0] + two[0]), 0, 0)], len(second)
    done = [0] * len(first)  # cells visited in each row of the grid
    while heap:
        least, i, j = heapq.heappop(heap)
        cell = first[i] * n + second[j]
        if filled[cell]:
            yield -least, cell
        done[i] = j + 1
        if j + 1 < n and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (-(one[i] + two[j + 1]), i, j + 1))
        if i + 1 < len(first) and done[i + 1] == j:
            heapq.heappush(heap, (-(one[i + 1] + two[j]), i + 1, j))


def build(rows: DataFrame, n_rows: int) -> tuple[dict[int, Index], DataFrame]:
    """The index of every dimension, and its rows in blocks of cells: dim, grp, part, cells, ids, labels, matrix."""
    spark = rows.sparkSession
    share = max(1, n_rows // SAMPLE_ROWS)
    sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0).select("dim", "q").orderBy("dim", F.xxhash64("vec_id")).limit(
        4 * SAMPLE_ROWS).toPandas()
    codes = int(max(1, min(CODES, np.sqrt(n_rows / CELL_ROWS))))
    books: dict[int, Index] = {}
    for (dim,) in rows.select("dim").distinct().collect():
        here = sample["q"][sample["dim"] == dim].tolist() or [[0] * dim]
        points = np.array(here, float).reshape(len(here), dim)
        books[dim] = Index(tuple(_kmeans(part, codes) for part in (points[:, :dim // 2], points[:, dim // 2:])))
    shared = spark.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(3))
            code, far = np.zeros((len(dims), 2), np.int64), np.zeros((len(dims), 2))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                q = np.asarray(batch.column(2).take(pa.array(at)).flatten()).reshape(len(at), dim)
                for h, (half, centres) in enumerate(zip(shared.value[dim].halves(q), shared.value[dim].centres, strict=True)):
                    code[at, h] = nearest(half, centres)
                    far[at, h] = np.sqrt(((half - centres[code[at, h]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(code[:, 0]), pa.array(code[:, 1]), pa.array(far[:, 0]), pa.array(far[:, 1])],
                names=["vec_id", "label", "q", "dim", "c1", "c2", "far1", "far2"])

    marked = checkpointed(rows.select("vec_id", "label", "q", "dim").mapInArrow(
        coded, "vec_id long, label long, q array<bigint>, dim int, c1 long, c2 long, far1 double, far2 double"))
    for dim, index in books.items():
        index.radii = tuple(np.zeros(len(c)) for c in index.centres)
        index.rows = np.zeros(len(index.centres[0]) * len(index.centres[1]), np.int64)
    cells = marked.groupBy("dim", "c1", "c2").agg(F.count("*").alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2"))
    for c in cells.collect():  # at most CODES * CODES rows per dimension
        index = books[c["dim"]]
        index.radii[0][c["c1"]] = max(index.radii[0][c["c1"]], c["far1"])
        index.radii[1][c["c2"]] = max(index.radii[1][c["c2"]], c["far2"])
        index.rows[c["c1"] * len(index.centres[1]) + c["c2"]] = c["n"]
    for index in books.values():
        index.gather(BLOCK_ROWS)
    shared = spark.sparkContext.broadcast(books)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec_id, dims, c1, c2 = (np.asarray(batch.column(i)) for i in (0, 3, 4, 5))
            cell, group, part = (np.zeros(len(dims), np.int64) for _ in range(3))
            for dim in np.unique(dims).tolist():
                at, index = np.flatnonzero(dims == dim), shared.value[dim]
                cell[at] = c1[at] * len(index.centres[1]) + c2[at]
                group[at] = index.group[cell[at]]
                part[at] = (mixed(vec_id[at].astype(np.uint64)) % index.parts[group[at]].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(3), pa.array(group), pa.array(part), pa.array(cell), *(batch.column(i) for i in range(3))],
                names=["dim", "grp", "part", "cell", "vec_id", "label", "q"])

    return books, checkpointed(_packed(marked.select("vec_id", "label", "q", "dim", "c1", "c2").mapInArrow(
        dealt, "dim int, grp long, part long, cell long, vec_id long, label long, q array<bigint>")))


def packed(matrix: list[list[int]]) -> bytes:
    """A matrix of integers in the narrowest type that holds it."""
    whole = np.array(matrix, "<i8")
    largest = max(int(whole.max(initial=0)), -int(whole.min(initial=0)))
    return whole.astype("<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8").tobytes()


def _arrays(ids: bytes, labels: bytes, matrix: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    width = len(matrix) // (len(ids) * dim) if dim else 8
    return ids, np.frombuffer(labels, "<i8"), np.frombuffer(matrix, f"<i{width}").reshape(len(ids), dim)


def _packed(rows: DataFrame) -> DataFrame:
    """One row per block, its rows by cell. A block is cut at twice its size; the pieces are blocks too."""
    key, order = ["dim", "grp", "part"], ["dim", "grp", "part", "cell"]
    schema = "dim int, grp long, part long, cells binary, ids binary, labels binary, matrix binary"
    arrow = _arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def pack() -> pa.RecordBatch:
            columns = [np.array([h[i] for h in held], "<i8").tobytes() for i in range(3)]
            return pa.RecordBatch.from_pylist([dict(zip(arrow.names, [*at, *columns, packed([h[3] for h in held])], strict=True))], arrow)

        for batch in batches:
            for dim, group, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if [dim, group, part] != at or len(held) == 2 * BLOCK_ROWS:
                    if held:
                        yield pack()
                    at, held = [dim, group, part], []
                held.append(row)
        if held:
            yield pack()

    return rows.repartition(*key).sortWithinPartitions(*order).mapInArrow(run, schema)


def _anchors(rows: DataFrame, every: int) -> DataFrame:
    """Blocks of distinct anchors of one dimension."""
    schema = "dim int, ids binary, labels binary, matrix binary"
    arrow = _arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def pack(dim: int) -> pa.RecordBatch:
            part = held.pop(dim)
            return pa.RecordBatch.from_pylist([{
                "dim": dim, "ids": np.array([p[0] for p in part], "<i8").tobytes(),
                "labels": np.array([p[1] for p in part], "<i8").tobytes(), "matrix": packed([p[2] for p in part])}], arrow)

        for batch in batches:
            for vec_id, label, q, dim in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(dim, []).append((vec_id, label, q))
                if len(held[dim]) == ANCHOR_ROWS:
                    yield pack(dim)
        for dim in list(held):
            yield pack(dim)

    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "label", "q", "dim").dropDuplicates()
    return checkpointed(asked.mapInArrow(run, schema).select(
        "dim", F.monotonically_increasing_id().alias("block"), "ids", "labels", "matrix"))


def as_numbers(anchors: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which their products are exact: floating point where all sums fit, else Python integers."""
    largest = float(np.abs(anchors.astype(float)).max(initial=0)) * float(np.abs(matrix.astype(float)).max(initial=0)) * max(1, matrix.shape[1])
    kind = np.float32 if largest < 1 << 23 else np.float64 if largest < 1 << 52 else object
    return anchors.astype(kind), matrix.astype(kind)


def scores(anchor: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Products, held to 64 bits."""
    s = matrix @ anchor
    return np.clip(s, -(1 << 63), (1 << 63) - 1).astype(np.int64) if s.dtype == object else s.astype(np.int64)


def _first(ids: np.ndarray, worth: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best allowed values, ties to smaller ids."""
    at = np.flatnonzero(ok)
    if len(at) > 8 * k:
        least = np.partition(worth[at], len(at) - k)[len(at) - k]
        at = at[worth[at] >= least]
    return at[np.lexsort((ids[at], -worth[at]))[:k]]


def _routes(asked: DataFrame, books, stop) -> DataFrame:
    """Which cells the anchors of a block visit, by group: dim, grp, part, block, anchors' numbers and cells in pairs.

    ``stop(row, n)`` gives, per anchor, the least bound worth visiting, after how many rows to pause, and how
    many rows the cells already visited held.
    """
    schema = "dim int, grp long, part long, block long, rows binary, visits binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                index = books.value[row.dim]
                ids, _, matrix = _arrays(row.ids, row.labels, row.matrix, row.dim)
                wanted: dict[int, list[tuple[int, int]]] = {}  # of a group: (cell, anchor), by anchor
                least, pause, resume = stop(row, len(ids))
                for i in range(len(ids)):
                    seen = 0
                    for bound, cell in visit(index.bounds(matrix[i]), index.rows):
                        if bound < least[i] or seen >= pause:
                            break
                        if seen >= resume:
                            wanted.setdefault(int(index.group[cell]), []).append((cell, i))
                        seen += int(index.rows[cell])
                rows = []
                for group, pairs in wanted.items():
                    cells, some = np.array(pairs, "<i4").T
                    rows += [(row.dim, group, part, row.block, some.tobytes(), cells.tobytes()) for part in range(index.parts[group])]
                yield pd.DataFrame(rows, columns=["dim", "grp", "part", "block", "rows", "visits"])

    return asked.mapInPandas(run, schema)


def _met(routes: DataFrame, asked: DataFrame, blocks: DataFrame, answer) -> DataFrame:
    """(block, row, window, vec_id, score): what ``answer(asked row, anchor, its id and label, ids, labels, scores)``
    picks from the cells of a block that an anchor visits, as (window, positions)."""
    named = asked.select("dim", "block", F.col("ids").alias("own_ids"), F.col("labels").alias("own_labels"), F.col("matrix").alias("own"), *[
        c for c in asked.columns if c not in ("dim", "block", "ids", "labels", "matrix")])
    sides = routes.join(named.drop("dim"), "block").join(blocks, ["dim", "grp", "part"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                own_ids, own_labels, anchors = _arrays(row.own_ids, row.own_labels, row.own, row.dim)
                ids, labels, matrix = _arrays(row.ids, row.labels, row.matrix, row.dim)
                cells, some, visits = np.frombuffer(row.cells, "<i8"), np.frombuffer(row.rows, "<i4"), np.frombuffer(row.visits, "<i4")
                anchors, matrix = as_numbers(anchors, matrix)
                first, out = np.searchsorted(cells, visits), []
                size = np.searchsorted(cells, visits, "right") - first
                for lo, hi in zip(*_runs(some), strict=True):
                    i, n = int(some[lo]), size[lo:hi]
                    at = np.repeat(first[lo:hi] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    s = scores(anchors[i], matrix[at])
                    for window, picked in answer(row, i, own_ids[i], own_labels[i], ids[at], labels[at], s):
                        out += [(row.block, i, window, ids[at[j]], s[j]) for j in picked.tolist()]
                yield pd.DataFrame(out, columns=["block", "row", "window", "vec_id", "score"])

    return sides.mapInPandas(run, _FOUND)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of equal values."""
    edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
    return edges[:-1], edges[1:]


_FOUND = "block long, row int, window int, vec_id long, score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of every anchor's window. Each block of rows answers with k at most."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id")))
    return found.groupBy("block", "row", "window").agg(F.slice(order, 1, k).alias("best"))


def _certified(asked: DataFrame, blocks: DataFrame, books, answer, worth, k: int) -> DataFrame:
    """(block, row, window, best) after two visits: the first cells of each anchor, then those that may still add.

    ``worth(asked row, anchor, kth)`` is the least score that may still count, where ``kth(window)`` is the
    window's k-th best score of the first visit, None if it has fewer.
    """
    def probe(row, n):
        return [worth(row, i, lambda window: None) for i in range(n)], PROBE_ROWS, 0

    seen = checkpointed(_best(_met(_routes(asked, books, probe), asked, blocks, answer), k))
    kth = seen.filter(F.size("best") == k).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct(
        (F.col("row") * F.lit(1 << 32) + F.col("window")).alias("at"), (-F.element_at("best", -1)["less"]).alias("score")))).alias("kth"))

    def rest(row, n):
        full = row.kth or {}
        return [worth(row, i, lambda window, i=i: full.get((i << 32) + window)) for i in range(n)], np.inf, PROBE_ROWS

    more = _met(_routes(asked.join(kth, "block", "left"), books, rest), asked, blocks, answer)
    again = seen.select("block", "row", "window", F.explode("best").alias("b")).select(
        "block", "row", "window", F.col("b.vec_id").alias("vec_id"), (-F.col("b.less")).alias("score"))
    return checkpointed(_best(more.unionByName(again), k))


def positives(asked: DataFrame, blocks: DataFrame, books, k: int) -> DataFrame:
    """(block, row, best) for anchors with other rows of their label; best holds (less, vec_id), less = -score."""
    def answer(row, i, own, label, ids, labels, s):
        yield 0, _first(ids, s, (labels == label) & (ids != own), k)

    def worth(row, i, kth):
        return -np.inf if kth(0) is None else kth(0)

    return _certified(asked, blocks, books, answer, worth, k).drop("window")


def windows(asked: DataFrame, blocks: DataFrame, books, k: int, low: int, high: int) -> DataFrame:
    """(block, row, window, best) of the negatives; ``asked`` has each anchor's distinct positive scores, falling."""
    def spans(row, i):
        return [(-(-low * s // 100), s * high // 100) for s in _of(row.wanted, i)]

    def answer(row, i, own, label, ids, labels, s):
        for window, (least, most) in enumerate(spans(row, i)):
            yield window, _first(ids, s, (labels != label) & (s >= least) & (s <= most), k)

    def worth(row, i, kth):
        return min((least if kth(window) is None else kth(window) for window, (least, most) in enumerate(spans(row, i)) if least <= most),
                   default=np.inf)

    return _certified(asked, blocks, books, answer, worth, k)


def _of(wanted, i: int) -> list[int]:
    return [] if wanted is None or wanted[i] is None else [int(s) for s in wanted[i]]


def mine(vectors: DataFrame, every: int = EVERY, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH, scale: int = SCALE, relabel: int = RELABEL, classes: int = CLASSES) -> DataFrame:
    """One row per anchor, positive and negative found for them.

    Columns: anchor_id, positive_id, rank (1 is the best), negative_id, positive_score, negative_score.

    Rows with a null vec_id or label, a null vector, or a null or non-finite component take no part. Vectors are
    compared with those of as many components only. An anchor's own vec_id is never its positive; rows that
    share an anchor's id but not its label can be negatives. Repeated rows are candidates each, repeated anchors are
    asked once, and anchors that share an id but not a vector or label are asked apart. Positives with no row in their
    window give no row, and so do tables without rows. Scores stop at the limits of a long.
    """
    rows = checkpointed(eligible(vectors, scale, relabel, classes, max(n_positives, n_negatives)))
    books, blocks = build(rows, rows.count())
    asked = _anchors(rows, every)
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    near = positives(asked, blocks, shared, n_positives)
    wanted = near.select("block", "row", F.array_distinct(F.transform("best", lambda b: -b["less"])).alias("wanted"))
    by_row = wanted.groupBy("block").agg(F.collect_list(F.struct("row", "wanted")).alias("wanted"))
    sizes = asked.select("block", (F.length("ids") / 8).cast("int").alias("n"))
    filled = by_row.join(sizes, "block").select("block", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.element_at(
        F.map_from_entries("wanted"), i)).alias("wanted"))
    found = windows(asked.join(filled, "block"), blocks, shared, n_negatives, low, high)
    scored = near.join(wanted, ["block", "row"]).select("block", "row", "wanted", F.explode("best").alias("p")).select(
        "block", "row", F.col("p.vec_id").alias("positive_id"), (-F.col("p.less")).alias("positive_score"),
        (F.array_position("wanted", -F.col("p.less")) - 1).cast("int").alias("window"))
    names = asked.select("block", "ids").mapInPandas(_numbered, "block long, row int, anchor_id long")
    negatives = found.select("block", "row", "window", F.posexplode("best").alias("at", "b"))
    return scored.join(negatives, ["block", "row", "window"]).join(names, ["block", "row"]).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("negative_id"),
        "positive_score", (-F.col("b.less")).alias("negative_score"))


def _numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples():
            ids = np.frombuffer(row.ids, "<i8")
            yield pd.DataFrame({"block": row.block, "row": np.arange(len(ids), dtype=np.int32), "anchor_id": ids})
