"""Spelling variants: words one edit apart, found with k-d trees over letter-count vectors.

One inserted or deleted letter changes a word's letter counts by one, one replaced letter by two, so near words lie
within L1 distance two, and one if their lengths differ. Words of one length are cut by the top of a k-d tree into
blocks of bounded size; a word meets the blocks of its own and the next length whose boxes are near enough.
Inside a block a second tree prunes by boxes again, and what is left is compared letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import parts_for
from .common import _arrow_schema, _slices, checkpointed, map_batches

RUN = re.compile("[A-Za-zÀ-ÿ]+")
DELETED_EVERY = 97
LETTERS = 5  # a word has so many code points at least
TIMES = 3  # and occurs so often
LEAD = 2  # a form is so many times as frequent
DIMENSIONS = 32  # 26 letters, and the others dealt over the rest
MOST = 60
BLOCK_ROWS = 32_768  # words a block holds; twice as many at most
LEAF_ROWS = 48
SAMPLE_ROWS = 65_536  # words of a length from which the cuts between blocks are chosen; results do not depend on it
FLUSH_WORDS = 1 << 18  # a task hands on its counts when it holds so many different words
SMALL_LETTERS = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # upper-case A to Z as lower case


def changed(doc_id, run: str, every: int = DELETED_EVERY) -> str:
    """A lower-cased run, without one letter where the crc32 of id and run says so. A null id reads as no text."""
    h = zlib.crc32(run.encode(), zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode()))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, every: int = DELETED_EVERY, letters: int = LETTERS) -> DataFrame:
    """(word, n) of whole texts, counted within tasks first."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(w, n) for w, n in counts.items() if len(w) >= letters]
            counts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], schema=schema)

        for batch in batches:
            for ids, texts in _slices(batch):
                for doc_id, text in zip(ids, texts, strict=True):
                    lead = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
                    here = Counter(RUN.findall(text.translate(SMALL_LETTERS).decode(errors="replace")))
                    for word, n in here.items():
                        if zlib.crc32(word.encode(), lead) % every == 0:
                            counts[changed(doc_id, word, every)] += n
                        else:
                            counts[word] += n
                if len(counts) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    return map_batches(docs.select("doc_id", "text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts, one row per word; letters beyond a to z share the last dimensions.

    Counts stop at MOST, which never moves two words farther apart."""
    out = np.zeros((len(words), DIMENSIONS), np.int32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    plain = (points >= 97) & (points <= 122)
    np.add.at(out, (np.repeat(np.arange(len(words)), lengths), np.where(plain, points - 97, 26 + points % (DIMENSIONS - 26))), 1)
    return np.minimum(out, MOST).astype(np.int8)


def reach(length: int, other: int) -> int:
    """How far apart letter counts of near words are at most, by the words' lengths."""
    return 2 if length == other else 1


def _cut(points: np.ndarray) -> tuple[int, int] | None:
    """Dimension and value of the cut that halves the points best: values up to it go to the left."""
    best, found = 0, None
    n = len(points)
    for d in np.argsort(-points.var(0), kind="stable")[:6].tolist():
        values, counts = np.unique(points[:, d], return_counts=True)
        left = np.cumsum(counts)[:-1]
        if len(left):
            at = int(np.argmax(np.minimum(left, n - left)))
            less = int(min(left[at], n - left[at]))
            if less > best:
                best, found = less, (d, int(values[at]))
    return found


def grow(points: np.ndarray, depth: int):
    """The top of a k-d tree: nested (dimension, value, left, right), None where a block is."""
    cut = _cut(points) if depth and len(points) > 1 else None
    if cut is None:
        return None
    left = points[:, cut[0]] <= cut[1]
    return (*cut, grow(points[left], depth - 1), grow(points[~left], depth - 1))


def place(tree, points: np.ndarray) -> np.ndarray:
    """The block number of every point; blocks are numbered as in a full binary tree."""
    out = np.ones(len(points), np.int64)
    todo = [(tree, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        if node is not None and len(rows):
            d, value, left, right = node
            low = points[rows, d] <= value
            out[rows] = out[rows] * 2 + ~low
            todo += [(left, rows[low]), (right, rows[~low])]
    return out


def near_boxes(points: np.ndarray, low: np.ndarray, high: np.ndarray, within: int) -> np.ndarray:
    """Which points lie within an L1 distance of a box."""
    return (np.maximum(low - points, 0) + np.maximum(points - high, 0)).sum(1, dtype=np.int16) <= within


class LetterTree:
    """A k-d tree over the letter counts of words of one length."""

    def __init__(self, words: list[str]):
        self.words = words
        self.points = vectors(words)
        self.codes = _codes(words)
        self.root = self._node(np.arange(len(words)))

    def _node(self, rows: np.ndarray):
        points = self.points[rows]
        cut = _cut(points) if len(rows) > LEAF_ROWS else None
        parts = rows
        if cut is not None:
            left = points[:, cut[0]] <= cut[1]
            parts = (self._node(rows[left]), self._node(rows[~left]))
        return points.min(0), points.max(0), parts

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(asked, found) numbers of all pairs of words one edit apart; the asked words are of one length."""
        points, codes = vectors(words), _codes(words)
        within = reach(len(words[0]), self.codes.shape[1])
        asked, found = [], []
        todo = [(self.root, np.arange(len(words)))]
        while todo:
            (low, high, parts), rows = todo.pop()
            rows = rows[near_boxes(points[rows], low, high, within)]
            if not len(rows):
                continue
            if isinstance(parts, tuple):
                todo += [(part, rows) for part in parts]
                continue
            for at in range(0, len(rows), 4096):
                some = rows[at:at + 4096]
                for start in range(0, len(parts), 512):
                    here = parts[start:start + 512]
                    a, b = np.nonzero(np.abs(points[some][:, None] - self.points[here][None]).sum(2, dtype=np.int16) <= within)
                    fits = one_edit(codes[some[a]], self.codes[here[b]])
                    asked.append(some[a[fits]])
                    found.append(here[b[fits]])
        empty = np.empty(0, np.int64)
        return np.concatenate([empty, *asked]), np.concatenate([empty, *found])


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of code points differ by exactly one inserted, deleted or replaced code point."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    n = a.shape[1]
    if b.shape[1] != n + 1:
        return np.zeros(len(a), bool)
    front, back = a != b[:, :-1], a != b[:, 1:]
    first = np.where(front.any(1), front.argmax(1), n)
    last = np.where(back.any(1), n - 1 - back[:, ::-1].argmax(1), -1)
    return last < first


def _trees(words: DataFrame, sizes: dict[int, int], block_rows: int) -> dict[int, tuple]:
    """The top tree of every length with more words than a block, from a sample by hash."""
    large = {length: n for length, n in sizes.items() if n > block_rows}
    trees = {}
    for length, n in large.items():
        share = max(1, n // SAMPLE_ROWS)
        sample = words.filter((F.length("word") == length) & (F.pmod(F.xxhash64("word"), F.lit(share)) == 0)).select("word").toPandas()
        trees[length] = grow(vectors(sample["word"].tolist()), (parts_for(n, block_rows) - 1).bit_length())
    return trees


def near_words(words: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(word, n_near, form_n, form) of all words (word, n) that have near words.

    Blocks hold words of one place in a length's tree, by hash where the tree cannot cut on. A word is sent to the
    blocks of its own length and the next whose boxes it may reach; each block answers with a count and the most
    frequent near word, for its own words too if they are longer, and the answers of all blocks are put together.
    """
    spark = words.sparkSession
    sizes = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(_trees(words, sizes, block_rows))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            length = np.fromiter(map(len, texts), np.int64, len(texts))
            points, cell = vectors(texts), np.ones(len(texts), np.int64)
            for one in np.unique(length).tolist():
                if (tree := shared.value.get(one)) is not None:
                    rows = np.flatnonzero(length == one)
                    cell[rows] = place(tree, points[rows])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(length), pa.array(cell), pa.array(list(points.astype(np.int32)))],
                names=["word", "n", "length", "cell", "counts"])

    cells = checkpointed(words.select("word", "n").mapInArrow(
        placed, "word string, n long, length long, cell long, counts array<int>"))
    bounds = [F.min(F.col("counts")[d]).alias(f"low{d}") for d in range(DIMENSIONS)]
    bounds += [F.max(F.col("counts")[d]).alias(f"high{d}") for d in range(DIMENSIONS)]
    boxes = cells.groupBy("length", "cell").agg(F.count("*").alias("n"), *bounds).orderBy("length", "cell").collect()
    boxed: dict[int, list] = {}
    for box in boxes:  # one row per block of up to block_rows words: no word reaches the driver
        boxed.setdefault(box["length"], []).append((
            box["cell"], parts_for(box["n"], 2 * block_rows), np.array(box[3:3 + DIMENSIONS], np.int8), np.array(box[3 + DIMENSIONS:], np.int8)))
    known = spark.sparkContext.broadcast(boxed)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, length = batch.column(0), batch.column(1), np.asarray(batch.column(2))
            points = np.asarray(batch.column(3).flatten()).astype(np.int8).reshape(-1, DIMENSIONS)
            for own in np.unique(length).tolist():
                rows = np.flatnonzero(length == own)
                for other in (own, own + 1):
                    for cell, parts, low, high in known.value.get(other, []):
                        hits = rows[near_boxes(points[rows], low, high, reach(own, other))]
                        if len(hits):
                            for part in range(parts):
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(np.full(len(hits), x)) for x in (other, cell, part)] + [texts.take(pa.array(hits)), n.take(pa.array(hits))],
                                    names=["length", "cell", "part", "asked", "n"])

    n_parts = F.lit(1)
    split = [(length, cell, parts) for length, found in boxed.items() for cell, parts, *_ in found if parts > 1]
    for length, cell, parts in split:
        n_parts = F.when((F.col("length") == length) & (F.col("cell") == cell), F.lit(parts)).otherwise(n_parts)
    part = F.pmod(F.xxhash64("word"), n_parts).cast("long")
    rows = cells.select("length", "cell", part.alias("part"), F.lit(None).cast("string").alias("asked"), "word", "n")
    asked = cells.select("word", "n", "length", "counts").mapInArrow(
        routed, "length long, cell long, part long, asked string, n long").select(
        "length", "cell", "part", "asked", F.lit(None).cast("string").alias("word"), "n")
    schema = "asked string, n_near long, form_n long, form string"
    arrow = _arrow_schema(spark, schema)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds whole blocks in turn, each block's words before the words that ask it."""
        at, tree = None, None
        block, counts, ask, times = [], [], [], []

        def answers() -> Iterator[pa.RecordBatch]:
            lengths = np.fromiter(map(len, ask), np.int64, len(ask))
            for length in np.unique(lengths).tolist():
                here = np.flatnonzero(lengths == length)
                words, n = [ask[i] for i in here.tolist()], np.array(times)[here]
                i, j = tree.near(words)
                yield _summed(i, words, j, block, np.array(counts), arrow)
                if length != len(block[0]):  # the block's words are not sent to the shorter ones
                    yield _summed(j, block, i, words, n, arrow)
            ask.clear()
            times.clear()

        for batch in batches:
            keys = np.stack([np.asarray(c) for c in batch.columns[:3]])
            for lo, hi in zip(*_runs(keys), strict=True):
                if (key := tuple(keys[:, lo].tolist())) != at:
                    if ask:
                        yield from answers()
                    at, tree = key, None
                    block, counts = [], []
                part = batch.slice(lo, hi - lo)
                own = part.column(3).null_count
                block += part.column(4).slice(0, own).to_pylist()
                counts += part.column(5).slice(0, own).to_pylist()
                ask += part.column(3).slice(own).to_pylist()
                times += part.column(5).slice(own).to_pylist()
                if ask and tree is None:
                    tree = LetterTree(block)
                if len(ask) >= BLOCK_ROWS:
                    yield from answers()
        if ask:
            yield from answers()

    blocks = rows.unionAll(asked).repartition("length", "cell", "part").sortWithinPartitions(
        "length", "cell", "part", F.col("asked").asc_nulls_first())
    found = blocks.mapInArrow(searched, schema)
    return found.groupBy(F.col("asked").alias("word")).agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("top")).select(
        "word", "n_near", (-F.col("top.less")).alias("form_n"), F.col("top.form").alias("form"))


def _summed(i: np.ndarray, words: list[str], j: np.ndarray, others: list[str], n: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """Per word in pairs (i, j): how many near words, and the most frequent of them, ties to the smallest."""
    named = np.unique(j)
    rank = np.zeros(len(others), np.int64)
    rank[sorted(named.tolist(), key=others.__getitem__)] = np.arange(len(named))  # code points, as UTF-8 bytes
    order = np.lexsort((rank[j], -n[j], i))
    i, j = i[order], j[order]
    lo, hi = _runs(i[None])
    top = j[lo]
    return pa.RecordBatch.from_arrays(
        [pa.array([words[k] for k in i[lo].tolist()], pa.string()), pa.array(hi - lo, pa.int64()), pa.array(n[top], pa.int64()),
         pa.array([others[k] for k in top.tolist()], pa.string())], schema=schema)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of equal columns."""
    if not values.shape[1]:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edges = np.flatnonzero(np.concatenate(([True], (values[:, 1:] != values[:, :-1]).any(0), [True])))
    return edges[:-1], edges[1:]


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word over ``forms`` (word, form), by doubling the steps each round.

    A form is at least twice as frequent as its word, so there are no circles and few rounds.
    """
    state = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        on = state.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        state = checkpointed(state.join(on, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if state.filter("moved").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def variants(docs: DataFrame, every: int = DELETED_EVERY, letters: int = LETTERS, times: int = TIMES, lead: int = LEAD,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the letter runs of whole texts, lower-cased from A to Z, one letter in places deleted, with ``letters``
    code points and ``times`` occurrences at least. ``form`` is the most frequent near word, ties to the smallest, if
    ``lead`` times as frequent; else null. Null and empty texts have no words; the null doc_id reads as no text in the
    deletion rule; repeated rows count again; an empty table gives no rows. Other columns are not looked at.
    """
    words = checkpointed(word_counts(docs, every, letters).filter(F.col("n") >= times))
    near = near_words(words, block_rows)
    known = checkpointed(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("form_n") >= F.col("n") * lead, F.struct("form", "form_n")).alias("top")).select(
        "word", "top.form", "n", "n_near", "top.form_n"))
    last = roots(known.filter("form IS NOT NULL"))
    return known.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
