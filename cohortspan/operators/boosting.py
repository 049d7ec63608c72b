"""Boosted trees from histograms: second-order gains, the models of all folds grown side by side.

Features become bins once. A level of the trees of all models is one aggregate of gradients keyed by (model, node,
feature, bin), and each node's best split is found where its sums meet; only splits reach the driver. Where the binned
training rows of every model are few enough for a task (counted first), they are shuffled to one task per model instead,
where the same functions grow the same trees.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checkpointed
from ..sources.schemas import IMPORTANCE

CUTS = 64  # candidate thresholds of a feature
MISSING = CUTS  # the bin of nulls; the others are numbered up to the number of cuts
LOCAL_BYTES = 128 << 20  # a model with binned training rows up to this size is grown in one task
WRITTEN_TREES = 8  # between two writings of the rows' margins
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class TreeParams:
    """Boosted-tree settings; the defaults are the tuned ones used for cross-validation."""

    trees: int = 400
    depth: int = 8
    rate: float = 0.09
    subsample: float = 0.9
    column_sample: float = 0.1
    gamma: float = 0.4
    seed: int = 42
    child_weight: float = 0.0
    l2: float = 1.0


# The settings of the attribution runs and of an untuned booster.
ATTRIBUTION_TREES = TreeParams(trees=100)
PLAIN_TREES = TreeParams(trees=100, depth=6, rate=0.3, subsample=1.0, column_sample=1.0, gamma=0.0, child_weight=1.0)


@dataclass
class Tree:
    """Nodes in the order of their levels. A row goes left if its bin is at most ``cut``, a null by ``null_left``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    null_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])  # of a leaf, the rate included
    cover: list[float] = field(default_factory=lambda: [0.0])  # sum of second derivatives
    gain: list[float] = field(default_factory=lambda: [0.0])
    begin: int = 0  # nodes from here on are not yet looked at

    def split(self, splits: pd.DataFrame, params: TreeParams, depth: int) -> None:
        """Take the open nodes' best splits (node, feature, cut, null_left, gain, g, h); open their children."""
        first = len(self.feature)
        for s in splits.sort_values("node").itertuples():
            self.cover[s.node] = s.h
            self.value[s.node] = -params.rate * s.g / (s.h + params.l2)
            if depth < params.depth and s.gain > LEAST_GAIN and s.gain >= params.gamma:
                self.feature[s.node], self.cut[s.node], self.null_left[s.node] = s.feature, s.cut, bool(s.null_left)
                self.left[s.node], self.gain[s.node] = len(self.feature), s.gain
                for _ in range(2):
                    for name, blank in (("feature", -1), ("cut", 0), ("null_left", False), ("left", -1), ("value", 0.0), ("cover", 0.0), ("gain", 0.0)):
                        getattr(self, name).append(blank)
        self.begin = first

    @property
    def open(self) -> bool:
        return self.begin < len(self.feature)

    def step(self, nodes: np.ndarray, bins: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
        """Where rows go from their nodes; rows in a leaf stay. ``columns``: the features ``bins`` has, if not all."""
        feature, left = np.array(self.feature), np.array(self.left)[nodes]
        place = np.maximum(feature, 0) if columns is None else np.minimum(np.searchsorted(columns, feature), len(columns) - 1)
        feature = feature[nodes]
        at = bins[np.arange(len(bins)), place[nodes]]
        goes_left = np.where(at == MISSING, np.array(self.null_left)[nodes], at <= np.array(self.cut)[nodes])
        return np.where(feature < 0, nodes, left + ~goes_left)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        while True:
            to = self.step(at, bins)
            if (to == at).all():
                return at
            at = to

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Forest:
    cuts: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return binned(x, self.cuts)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return sum((t.predict(bins) for t in self.trees), np.zeros(len(bins)))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(c, x[:, j]))
    return out


def drawn(keys: np.ndarray, params: TreeParams, tree: int, model: int) -> np.ndarray:
    """Which rows a tree is grown on: a hash of row, tree and model, so that reruns agree."""
    if params.subsample >= 1:
        return np.ones(len(keys), bool)
    salt = np.uint64((params.seed * 1_000_003 + tree) * 1009 + model)
    with np.errstate(over="ignore"):
        x = (keys.view(np.uint64) ^ (salt * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(float) / float(1 << 53) < params.subsample


def columns_of(params: TreeParams, n_features: int, tree: int, model: int) -> np.ndarray:
    """The features a tree may use."""
    n = max(1, int(params.column_sample * n_features))
    return np.sort(np.random.default_rng([params.seed, tree, model]).permutation(n_features)[:n])


def histograms(bins: np.ndarray, nodes: np.ndarray, g: np.ndarray, h: np.ndarray, n_nodes: int, features: np.ndarray) -> np.ndarray:
    """Sums of both derivatives by node, feature and bin; the last bin is of nulls."""
    out = np.empty((n_nodes, len(features), MISSING + 1, 2))
    for j, f in enumerate(features.tolist()):
        at = nodes * (MISSING + 1) + bins[:, f]
        for k, weight in enumerate((g, h)):
            out[:, j, :, k] = np.bincount(at, weight, n_nodes * (MISSING + 1)).reshape(n_nodes, -1)
    return out


def best_splits(sums: np.ndarray, features: np.ndarray, first: int, params: TreeParams) -> pd.DataFrame:
    """The best split of every node: node, feature, cut, null_left, gain, g, h (the node's sums)."""
    total = sums[:, :1].sum(2, keepdims=True)
    below = np.cumsum(sums[:, :, :-1], 2)
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + params.l2)
    gains = []
    for left in (below, below + sums[:, :, -1:]):  # nulls to the right, nulls to the left
        right = total - left
        least = np.minimum(left[..., 1], right[..., 1])
        gains.append(np.where((least > 1e-12) & (least >= params.child_weight), worth(left) + worth(right) - worth(total), -np.inf))
    flat = np.stack(gains, -1).reshape(len(sums), -1)
    best = flat.argmax(1)
    f, cut, null_left = np.unravel_index(best, (*below.shape[1:3], 2))
    return pd.DataFrame({
        "node": first + np.arange(len(sums)), "feature": features[f], "cut": cut, "null_left": null_left.astype(bool),
        "gain": flat[np.arange(len(sums)), best], "g": total[:, 0, 0, 0], "h": total[:, 0, 0, 1]})


def grow(bins: np.ndarray, y: np.ndarray, keys: np.ndarray, cuts: list[np.ndarray], params: TreeParams, model: int) -> Forest:
    """One model from rows in memory."""
    forest, margin = Forest(cuts), np.zeros(len(y))
    for number in range(params.trees):
        p = 1 / (1 + np.exp(-margin))
        used = drawn(keys, params, number, model)
        g, h = np.where(used, p - y, 0.0), np.where(used, p * (1 - p), 0.0)
        features = columns_of(params, len(cuts), number, model)
        own = bins[:, features]
        tree, nodes, depth = Tree(), np.zeros(len(y), np.int64), 0
        while tree.open:
            rows = np.flatnonzero(nodes >= tree.begin)
            first, part = tree.begin, own[rows]
            sums = histograms(part, nodes[rows] - first, g[rows], h[rows], len(tree.feature) - first, np.arange(len(features)))
            tree.split(best_splits(sums, features, first, params), params, depth)
            nodes[rows] = tree.step(nodes[rows], part, features)
            depth += 1
        margin += np.array(tree.value)[nodes]
        forest.trees.append(tree)
    return forest


@dataclass
class Folds:
    """A written table (repeat, fold, kept columns, y, key, x) and its features' cuts."""

    table: DataFrame
    cuts: list[np.ndarray]
    y: str
    splits: list[tuple[int, int]]


def prepare(folded: DataFrame, xs: Sequence[str], y: str, keys: Sequence[str], splits: Sequence[tuple[int, int]] | None = None) -> Folds:
    """Lay out rows for :func:`fit`. Nulls and NaN are missing values; candidate cuts are quantiles of all rows."""
    x = F.array(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in xs])
    table = checkpointed(folded.select("repeat", "fold", *keys, y, F.xxhash64(*keys).alias("key"), x.alias("x")))
    at = F.lit([i / CUTS for i in range(1, CUTS)])
    found = table.agg(*[F.struct(F.percentile_approx(F.col("x")[i], at, 20_000).alias("q"), F.max(F.col("x")[i]).alias("most")).alias(f"c{i}")
                        for i in range(len(xs))]).first()
    cuts = [np.array(sorted({v for v in c["q"] or [] if v < c["most"]}), float) for c in found]
    if splits is None:
        splits = [tuple(r) for r in table.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()]
    return Folds(table, cuts, y, list(splits))


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """Rows of a list column as a matrix, nulls as NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def fit(folds: Folds, params: TreeParams, local_bytes: int = LOCAL_BYTES) -> dict[tuple[int, int], Forest]:
    """One model per split (repeat, fold), grown on the repeat's other folds."""
    counts = folds.table.groupBy("repeat", "fold").count().collect()
    most = max((sum(c["count"] for c in counts if c["repeat"] == r and c["fold"] != f) for r, f in folds.splits), default=0)
    if most * (len(folds.cuts) + 24) <= local_bytes:
        return _fit_in_tasks(folds, params)
    return _fit_by_levels(folds, params)


def _fit_in_tasks(folds: Folds, params: TreeParams) -> dict[tuple[int, int], Forest]:
    cuts, splits, types = folds.cuts, folds.splits, ("<i8", "<i8", "<f8")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            repeat, *columns = (np.asarray(b.column(i)).astype(t) for i, t in enumerate(("<i8", *types)))
            bins = binned(matrix(b.column(4), b.num_rows), cuts)
            for model, (r, f) in enumerate(splits):
                rows = (repeat == r) & (columns[0] != f)
                if rows.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([model], pa.int32()), *(pa.array([c[rows].tobytes()], pa.binary()) for c in (*columns, bins))],
                        names=["model", "fold", "key", "y", "bins"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        model = int(frame["model"].iloc[0])
        fold, key, y = (np.frombuffer(b"".join(frame[c]), t) for c, t in zip(("fold", "key", "y"), types, strict=True))
        bins = np.frombuffer(b"".join(frame["bins"]), np.uint8).reshape(len(y), len(cuts))
        order = np.lexsort((y, fold, key))  # sums do not depend on how rows were dealt over tasks
        return pd.DataFrame({"model": [model], "trees": [pickle.dumps(grow(bins[order], y[order], key[order], cuts, params, model).trees)]})

    packed = folds.table.select("repeat", "fold", "key", folds.y, "x").mapInArrow(
        pack, "model int, fold binary, key binary, y binary, bins binary")
    # More partitions than models, so that few of them share one.
    grown = packed.repartition(4 * len(splits) or 1, "model").groupBy("model").applyInPandas(run, "model int, trees binary").collect()
    found = {r["model"]: pickle.loads(bytes(r["trees"])) for r in grown}
    none = np.zeros(0)
    return {split: Forest(cuts, found[m]) if m in found else grow(
        np.zeros((0, len(cuts)), np.uint8), none, none.astype(np.int64), cuts, params, m) for m, split in enumerate(splits)}


def _fit_by_levels(folds: Folds, params: TreeParams) -> dict[tuple[int, int], Forest]:
    spark, cuts, splits = folds.table.sparkSession, folds.cuts, folds.splits
    numbers = {s: i for i, s in enumerate(splits)}

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = binned(matrix(b.column(4), b.num_rows), cuts)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([r.tobytes() for r in bins], pa.binary())], names=["repeat", "fold", "key", "y", "bins"])

    schema = "repeat int, fold int, key long, y double, bins binary"
    state = folds.table.select(F.col("repeat").cast("int"), F.col("fold").cast("int"), "key", F.col(folds.y).cast("double").alias("y"), "x").mapInArrow(
        to_bins, schema).withColumn("margins", F.lit(None).cast("array<double>"))
    state = checkpointed(state)
    forests = [Forest(cuts) for _ in splits]

    def rows_of(b: pa.RecordBatch):
        """Per model: its training rows' numbers, keys, y, bins and margins up to ``done``."""
        repeat, fold, key, y = (np.asarray(b.column(i)) for i in range(4))
        bins = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(b.num_rows, len(cuts))
        held = b.column(5).to_pylist()
        margins = np.array([m or [0.0] * len(splits) for m in held]).reshape(b.num_rows, len(splits))
        for (r, f), model in numbers.items():
            rows = np.flatnonzero((repeat == r) & (fold != f))
            yield model, rows, key[rows], y[rows], bins[rows], margins[rows, model], margins

    def level(state: DataFrame, recent: list[list[Tree]], growing: dict[int, Tree], number: int) -> pd.DataFrame:
        shared = spark.sparkContext.broadcast((recent, growing))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            recent, growing = shared.value
            for b in batches:
                for model, _, key, y, bins, margin, _ in rows_of(b):
                    tree = growing.get(model)
                    if tree is None or not len(y):
                        continue
                    for t in recent[model]:
                        margin = margin + t.predict(bins)
                    p = 1 / (1 + np.exp(-margin))
                    nodes = tree.nodes(bins)
                    used = drawn(key, params, number, model) & (nodes >= tree.begin)
                    features = columns_of(params, len(cuts), number, model)
                    part = histograms(bins[used], nodes[used] - tree.begin, (p - y)[used], (p * (1 - p))[used], len(tree.feature) - tree.begin, features)
                    node, f, at = np.nonzero(part[..., 1])
                    yield pa.RecordBatch.from_pydict({
                        "model": pa.array(np.full(len(node), model), pa.int32()), "node": pa.array(node + tree.begin, pa.int32()),
                        "feature": pa.array(features[f], pa.int32()), "bin": pa.array(at, pa.int32()), "g": part[node, f, at, 0], "h": part[node, f, at, 1]})

        def choose(frame: pd.DataFrame) -> pd.DataFrame:
            model, node = int(frame["model"].iloc[0]), int(frame["node"].iloc[0])
            features = columns_of(params, len(cuts), number, model)
            table = np.zeros((1, len(features), MISSING + 1, 2))
            at = (np.zeros(len(frame), np.int64), np.searchsorted(features, frame["feature"]), frame["bin"].to_numpy())
            table[(*at, 0)], table[(*at, 1)] = frame["g"], frame["h"]
            return best_splits(table, features, node, params).assign(model=model)

        cells = state.mapInArrow(sums, "model int, node int, feature int, bin int, g double, h double").groupBy("model", "node", "feature", "bin").agg(
            F.sum("g").alias("g"), F.sum("h").alias("h"))
        return cells.groupBy("model", "node").applyInPandas(
            choose, "model int, node int, feature int, cut int, null_left boolean, gain double, g double, h double").toPandas()

    def with_margins(state: DataFrame, recent: list[list[Tree]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(recent)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                margins = np.zeros((b.num_rows, len(splits)))
                for model, rows, _, _, bins, margin, held in rows_of(b):
                    margins[rows, model] = sum((t.predict(bins) for t in shared.value[model]), margin)
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(list(margins), pa.list_(pa.float64()))], names=b.schema.names)

        return checkpointed(state.mapInArrow(add, f"{schema}, margins array<double>"))

    recent: list[list[Tree]] = [[] for _ in splits]
    for number in range(params.trees):
        trees, depth = [Tree() for _ in splits], 0
        while growing := {m: t for m, t in enumerate(trees) if t.open}:
            found = level(state, recent, growing, number)
            for model, tree in growing.items():
                tree.split(found[found["model"] == model], params, depth)
            depth += 1
        for forest, late, tree in zip(forests, recent, trees, strict=True):
            forest.trees.append(tree)
            late.append(tree)
        if len(recent[0]) == WRITTEN_TREES:
            state, recent = with_margins(state, recent), [[] for _ in splits]
    return dict(zip(splits, forests, strict=True))


def cross_score(folds: Folds, forests: Mapping[tuple[int, int], Forest], columns: Sequence[str]) -> DataFrame:
    """(repeat, fold, columns, score): held-out probabilities of all folds, in one scan."""
    types = dict(folds.table.dtypes)
    names = ["repeat", "fold", *columns]
    shared = folds.table.sparkSession.sparkContext.broadcast(dict(forests))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for split, rows in held_rows(b, shared.value):
                forest, part = shared.value[split], b.take(pa.array(rows))
                margin = forest.margin(forest.bins(matrix(part.column(part.num_columns - 1), len(rows))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(1 / (1 + np.exp(-margin)))], names=[*names, "score"])

    return folds.table.select(*names, "x").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", score double")


def held_rows(b: pa.RecordBatch, forests: Mapping[tuple[int, int], Forest]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """The rows of a batch (repeat and fold first) that a model did not see, model by model."""
    repeat, fold = np.asarray(b.column(0)), np.asarray(b.column(1))
    for split in forests:
        rows = np.flatnonzero((repeat == split[0]) & (fold == split[1]))
        if len(rows):
            yield split, rows


def gains(forest: Forest, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of gains and number of splits by feature."""
    total, splits = np.zeros(n_features), np.zeros(n_features, np.int64)
    for t in forest.trees:
        feature, inner = np.array(t.feature), np.array(t.feature) >= 0
        np.add.at(total, feature[inner], np.array(t.gain)[inner])
        np.add.at(splits, feature[inner], 1)
    return total, splits


def importances(forest: Forest, n_features: int) -> np.ndarray:
    """Mean gain of each feature's splits, as shares of one."""
    total, splits = gains(forest, n_features)
    mean = total / np.maximum(splits, 1)
    return mean / mean.sum() if mean.sum() else mean


def importance(spark: SparkSession, forest: Forest, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, importances(forest, len(names)), strict=True)], IMPORTANCE)


def fold_importance(spark: SparkSession, forests: Mapping[tuple[int, int], Forest], names: Sequence[str]) -> DataFrame:
    rows = [(*split, n, float(v)) for split, forest in forests.items() for n, v in zip(names, importances(forest, len(names)), strict=True)]
    return spark.createDataFrame(rows, "repeat int, fold int, feature string, importance double")


def split_counts(spark: SparkSession, forest: Forest, names: Sequence[str]) -> DataFrame:
    """How often each feature splits a node of the ensemble; features that never do are left out."""
    _, splits = gains(forest, len(names))
    return spark.createDataFrame([(n, int(k)) for n, k in zip(names, splits, strict=True) if k], "feature string, splits long")
