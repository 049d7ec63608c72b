"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation in numpy.

Counts of all training words come from the whole corpus, by Spark. The model's symbols are the most frequent
words, and classes for all other words by their last letters. The score of a symbol after two others is
bilinear in vectors of the context and of the symbol; as contexts are pairs of symbols, one batched matrix
product gives the normaliser of every pair, and a token's normalised log-probability is three table look-ups.
A word outside the symbols takes its class's probability times its share of the class, where each class keeps
a share for one unseen word. That share starts from smoothed counts; words counted ``LEAST`` times, among the
``HEAD`` most frequent, have vectors of their own, so the vocabulary grows with the corpus: within blocks of at
most ``BLOCK`` words of a class, a second log-bilinear model, fitted in Spark tasks block by block, moves
probability between the words by the word before.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _slices, checkpointed, map_batches, map_texts

FOLDS = 10
SMOOTHING = 0.1
SYMBOLS = 512  # frequent words with vectors of their own
CLASSES = 255  # of the other words; one more symbol is the text's edge
HEAD = 1 << 19  # words whose counts every task holds, 16 bytes each; the counts of all others are joined
DIMENSIONS = 24
STEPS = 150
NOISE = 10.0
LEAST = 64  # occurrences from which a word among the HEAD most frequent has a vector of its own
BLOCK = 2048  # words of a class that are normalised together, at most
BLOCK_DIMENSIONS, BLOCK_STEPS = 12, 48
PART = 16  # contexts counted together
CHECK = 1 << 26  # marks cells that tell when to stop
FLUSH_WORDS = 1 << 19  # a task hands on its counts when it holds so many different words


def words_of(text: bytes) -> list[bytes]:
    """The lower-cased words of a text and its end, the empty word."""
    return [*text.lower().split(), b""]


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def ending_class(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word.strip(b".,;:!?\"'()-#%&$*|")[-3:]) % CLASSES


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text modulo the folds; a null id is in fold 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)), F.lit(1)).cast("int")


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, n, word, class) of all words of ``docs`` (text), counted within tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = list(counts)
            out = pa.RecordBatch.from_arrays(
                [pa.array(map(word_key, words), pa.int64()), pa.array(counts.values(), pa.int64()),
                 pa.array([ending_class(w) for w in words], pa.int32())], names=["key", "n", "class"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()).to_pylist():
                counts.update(words_of(text or b""))
                if len(counts) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    return map_batches(docs.select("text"), run, "key long, n long, class int").groupBy("key").agg(
        F.sum("n").alias("n"), F.first("class").alias("class"))


def _frequent(counts: DataFrame, top: list) -> Column:
    """Condition for the symbols' words and the most frequent ones: whole classes of counts, an eighth of a power
    of two wide, that hold at most ``HEAD`` words together. Only the classes' sizes come to the driver."""
    level = F.floor(F.log2("n") * 8)
    least, held = 1 << 20, 0
    for at, words in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        held += words
        if held > HEAD:
            break
        least = at
    return (level >= least) | ~beyond(top, SYMBOLS)


@dataclass
class Model:
    """Tables by symbol: 0..S-1 frequent words, then the classes, then the edge as a context only."""

    words: Vocabulary
    near: np.ndarray  # log score of (previous, symbol), bias included
    far: np.ndarray  # log score of (one before, symbol)
    norm: np.ndarray  # log normaliser of (previous, one before)
    class_mass: np.ndarray  # smoothed count of each class, its unseen word included
    context: np.ndarray  # vectors of (block, previous)
    vectors: np.ndarray  # of the vocabulary's words, zero for those without
    level: np.ndarray  # log of the block's smoothed count less its normaliser, by (block, previous)

    def within(self, at: np.ndarray, one: np.ndarray) -> np.ndarray:
        """How much the log-probability of words within their class, after ``one``, departs from their share by counts."""
        out = np.zeros(len(at))
        if len(self.level):
            block = np.where(at >= 0, self.words.blocks[at], -1)
            own = np.flatnonzero(block >= 0)
            b, c = block[own], one[own]
            out[own] = (self.context[b, c] * self.vectors[at[own]]).sum(1) + self.level[b, c]
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1) if len(keys) else np.zeros(len(wanted), np.int64)
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def _symbols(keys: np.ndarray, classes: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words, and their places in the vocabulary (-1 outside)."""
    at, found = _find(words.keys, keys)
    at = np.where(found, at, -1)
    own = words.symbols[at] if len(words.keys) else at
    return np.where(found & (own >= 0), own, SYMBOLS + classes), at


def _coded(texts: list[bytes]):
    """Keys, classes and text numbers of all words of some texts; equal words are hashed once."""
    lists = [words_of(t) for t in texts]
    flat = [w for words in lists for w in words]
    known: dict[bytes, int] = {}
    index = np.fromiter((known.setdefault(w, len(known)) for w in flat), np.int64, len(flat))
    keys = np.fromiter(map(word_key, known), np.int64, len(known))
    classes = np.fromiter(map(ending_class, known), np.int64, len(known))
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return keys[index], classes[index], np.repeat(np.arange(len(lists)), counts), counts


def _contexts(symbols: np.ndarray, counts: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    one = np.concatenate(([edge], symbols[:-1]))
    two = np.concatenate(([edge, edge], symbols[:-2]))[:len(symbols)]
    one[first] = edge
    two[first] = edge
    later = first[counts > 1] + 1
    two[later] = edge
    return one, two


@dataclass
class Vocabulary:
    """The words with vectors: the symbols, and the blocks of the other frequent words. All sorted by key."""

    keys: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray  # of the words among the symbols, else -1
    blocks: np.ndarray  # of the others with a vector, else -1
    places: np.ndarray  # in the block

    def mass(self) -> list[np.ndarray]:
        """Smoothed counts of each block's words, by place."""
        held = np.flatnonzero(self.blocks >= 0)
        held = held[np.lexsort((self.places[held], self.blocks[held]))]
        sizes = np.bincount(self.blocks[held]) if len(held) else np.zeros(0, np.int64)
        return np.split(self.counts[held] + SMOOTHING, np.cumsum(sizes)[:-1]) if len(sizes) else []


def vocabulary(keys: np.ndarray, counts: np.ndarray, classes: np.ndarray, top: list[int]) -> Vocabulary:
    """Symbols for the keys in ``top``, and blocks, each within a class, for all others counted ``LEAST`` times."""
    order = np.argsort(keys)
    keys, counts, classes = keys[order], counts[order], classes[order]
    symbols = np.full(len(keys), -1)
    at, found = _find(keys, np.array(top, np.int64))
    symbols[at[found]] = np.flatnonzero(found)
    held = np.flatnonzero((symbols < 0) & (counts >= LEAST))
    held = held[np.argsort(classes[held], kind="stable")]
    sizes = np.bincount(classes[held], minlength=CLASSES)
    splits = -(-sizes // BLOCK)  # blocks of each class
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    rank, split = np.arange(len(held)) - first, splits[classes[held]]
    blocks, places = np.full(len(keys), -1), np.full(len(keys), -1)
    blocks[held] = (np.cumsum(splits) - splits)[classes[held]] + rank % np.maximum(split, 1)
    places[held] = rank // np.maximum(split, 1)
    return Vocabulary(keys, counts, symbols, blocks, places)


CELLS = "block int, part int, codes binary, ns binary"


def _cells(block: int, part: int, codes: np.ndarray, ns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "block": pa.array([block], pa.int32()), "part": pa.array([part], pa.int32()),
        "codes": pa.array([codes.astype("<i4").tobytes()], pa.binary()), "ns": pa.array([ns.astype("<i8").tobytes()], pa.binary())})


def _summed(codes: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, np.concatenate(ns))
    return found, total


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(key, codes, ns) of sorted rows of cells, equal codes of a key added up as they come."""
    key, codes, ns, held = None, [], [], 0
    for batch in batches:
        for row in batch.to_pylist():
            here = tuple(row[n] for n in names)
            if here != key and key is not None:
                yield key, *_summed(codes, ns)
                codes, ns, held = [], [], 0
            key = here
            codes.append(np.frombuffer(row["codes"], "<i4"))
            ns.append(np.frombuffer(row["ns"], "<i8"))
            held += len(codes[-1])
            if held > 1 << 22:
                merged = _summed(codes, ns)
                codes, ns, held = [merged[0]], [merged[1]], 0
    if key is not None:
        yield key, *_summed(codes, ns)


def pair_cells(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """How often words follow contexts, all texts, as packed cells, once per (block, part of the contexts).

    Blocks -1 and -2 count symbols one and two places after symbols (code: context * symbols + symbol); the
    others the words of a block after symbols (code: context * BLOCK + place, ``CHECK`` added in an eighth
    of the texts, by their hash, which tell when to stop fitting).
    """
    size = SYMBOLS + CLASSES + 1
    table = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size, size), np.int64)
        codes, held = [], 0

        def emit(block: np.ndarray, codes: np.ndarray, ns: np.ndarray, stride: int) -> Iterator[pa.RecordBatch]:
            if not len(codes):
                return
            part = (codes % CHECK) // stride // PART
            order = np.lexsort((part, block))
            block, part, codes, ns = block[order], part[order], codes[order], ns[order]
            edges = np.flatnonzero(np.diff(block, prepend=-9) | np.diff(part, prepend=-9))
            for lo, hi in zip(edges, [*edges[1:], len(block)], strict=True):
                yield _cells(block[lo], part[lo], codes[lo:hi], ns[lo:hi])

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                found, n = np.unique(np.concatenate(codes), return_counts=True)
                yield from emit(found >> 32, found & 0xFFFFFFFF, n, BLOCK)
                codes.clear()

        for batch in batches:
            pairs = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(0)], names=["i", "text"])
            for _, texts in _slices(pairs):
                k, c, owner, counts = _coded(texts)
                s, at = _symbols(k, c, table.value)
                one, two = _contexts(s, counts, size - 1)
                for d, context in enumerate((one, two)):
                    total[d] += np.bincount(context * size + s, minlength=size * size).reshape(size, size)
                check = np.array([xxhash.xxh32_intdigest(t) % 8 == 0 for t in texts])[owner]
                block = np.where(at >= 0, table.value.blocks[at], -1) if len(table.value.keys) else at
                own = block >= 0
                codes.append((block[own].astype(np.int64) << 32) + one[own] * BLOCK + table.value.places[at[own]] + check[own] * CHECK)
                held += len(codes[-1])
                if held > 1 << 22:
                    yield from flush()
                    held = 0
        yield from flush()
        for d in range(2):
            code = np.flatnonzero(total[d])
            yield from emit(np.full(len(code), -1 - d), code, total[d].ravel()[code], size)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block, part), codes, ns in _grouped(batches, ["block", "part"]):
            yield _cells(block, part, codes, ns)

    cells = map_batches(docs.select("text"), run, CELLS)
    return map_batches(cells.repartition("block", "part").sortWithinPartitions("block", "part"), merge, CELLS)


def fit_block(mass: np.ndarray, data: np.ndarray, check: np.ndarray, steps: int = BLOCK_STEPS, noise: float = NOISE,
              dimensions: int = BLOCK_DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of contexts and of a block's words from counts (context, word), by noise-contrastive estimation.

    The words' bias is their smoothed count and stays; noise is the block's words at that rate. Starts from
    context vectors of zero, which is the share by counts, and returns the vectors of the step that is best
    on the counts in ``check``: where contexts tell nothing, the share by counts remains.
    """
    share = (mass / mass.sum()).astype(np.float32)
    rng = np.random.default_rng(7)
    r = np.zeros((len(data), dimensions), np.float32)
    q = rng.normal(0, 0.3, (len(mass), dimensions)).astype(np.float32)
    best, best_value = (r.copy(), q.copy()), 0.0
    total = data.sum()
    if not total or not check.sum():
        return best
    rows = np.flatnonzero(data.sum(1))  # contexts never seen before the block's words keep zero
    table = (data[rows] / total).astype(np.float32)
    due = noise * table.sum(1, keepdims=True) * share
    held = check[rows]
    mine = np.zeros((len(rows), dimensions), np.float32)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (mine, q)]
    for step in range(1, steps + 1):
        p = 1 / (1 + noise * np.exp(-np.clip(mine @ q.T, -30, 30)))  # data against noise at one word
        g = table * (1 - p) - due * p
        grads = [g @ q, g.T @ mine]
        for w, grad, m in zip((mine, q), grads, moments, strict=True):
            m[0] += 0.1 * (grad - m[0])
            m[1] += 0.01 * (grad * grad - m[1])
            w += 0.05 * ((m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + np.float32(1e-9)) - 0.02 * w)
        if step % 4 == 0:
            scores = mine @ q.T
            value = float((held * scores).sum() - held.sum(1) @ np.log(np.exp(scores) @ share))
            if value <= best_value:
                break
            r[rows] = mine
            best, best_value = (r.copy(), q.copy()), value
    return best


def fit_blocks(cells: DataFrame, words: Vocabulary) -> list:
    """(block, context vectors, word vectors) of every block whose words have context vectors, one block at a time in a task."""
    size = SYMBOLS + CLASSES + 1
    shared = cells.sparkSession.sparkContext.broadcast(words.mass())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,), codes, ns in _grouped(batches, ["block"]):
            mass = shared.value[block]
            tables = np.zeros((2, size, len(mass)), np.int64)
            kept = codes % CHECK
            tables[codes // CHECK, kept // BLOCK, kept % BLOCK] = ns
            r, q = fit_block(mass, *tables)
            if r.any():
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block], pa.int32()), "r": pa.array([r.astype("<f4").tobytes()], pa.binary()),
                    "q": pa.array([q.astype("<f4").tobytes()], pa.binary())})

    rows = checkpointed(map_batches(cells.filter("block >= 0").repartition(max(1, int(words.blocks.max(initial=0)) // 4), "block").sortWithinPartitions("block"), run,
                                    "block int, r binary, q binary")).collect()
    return [(r["block"], np.frombuffer(bytes(r.r), "<f4").reshape(size, -1), np.frombuffer(bytes(r.q), "<f4").reshape(-1, BLOCK_DIMENSIONS))
            for r in rows]


def packed(rows: DataFrame) -> list:
    """The columns of ``rows`` (longs) on the driver, as one array each; they travel as bytes, not as objects."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.asarray(c, "<i8").tobytes()], pa.binary()) for c in batch.columns], names=names)

    sent = rows.select(*[F.col(c).cast("long").alias(c) for c in names]).mapInArrow(run, ", ".join(f"{c} binary" for c in names)).collect()
    return [np.frombuffer(b"".join(bytes(r[c]) for r in sent), "<i8") for c in names]


def fit(pairs: np.ndarray, dimensions: int = DIMENSIONS, steps: int = STEPS, noise: float = NOISE, seed: int = 7):
    """Vectors by noise-contrastive estimation over all pairs at once, both distances in turn.

    Data are the counted pairs, noise is the symbols' own frequency, ``noise`` times as often; its sum over
    symbols is taken whole instead of sampled. Returns the scores of (previous, symbol) and (one before, symbol).
    """
    size = pairs.shape[1]
    rng = np.random.default_rng(seed)
    total = pairs[0].sum()
    unigram = (pairs[0].sum(0) + 1.0) / (total + size)
    out = []
    for table in pairs:
        table = table / max(1, total)
        context = table.sum(1, keepdims=True)
        table, context = table.astype(np.float32), context.astype(np.float32)
        r, q = (rng.normal(0, 0.1, (size, dimensions)).astype(np.float32) for _ in range(2))
        b = np.log(unigram).astype(np.float32)
        weights, moments = [r, q, b], [[np.zeros_like(w), np.zeros_like(w)] for w in (r, q, b)]
        offset, due = np.log(noise * unigram).astype(np.float32), (noise * context * unigram).astype(np.float32)
        for step in range(1, steps + 1):
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-(r @ q.T + b - offset)))
            g = table * (1 - p) - due * p
            grads = [g @ q, g.T @ r, g.sum(0)]
            for w, grad, m in zip(weights, grads, moments, strict=True):
                m[0] += 0.1 * (grad - m[0])
                m[1] += 0.01 * (grad * grad - m[1])
                w += 0.05 * (1 - step / (steps + 1)) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + np.float32(1e-12))
        out.append(r @ q.T + b)
    return out, np.log(unigram)


def beyond(top: list, most: int) -> Column:
    """Condition for counts after the first ``most``, given those in order of falling n, then key."""
    if len(top) < most:
        return F.lit(False)
    return (F.col("n") < int(top[-1][1])) | ((F.col("n") == int(top[-1][1])) & (F.col("key") > int(top[-1][0])))


def train(docs: DataFrame, counts: DataFrame) -> tuple[Model, Column]:
    """The model of training ``docs`` (text) and their ``counts``, and the condition for its words."""
    top = counts.orderBy(F.desc("n"), "key").limit(SYMBOLS).select("key", "n").collect()
    frequent = _frequent(counts, top)
    words = vocabulary(*packed(counts.filter(frequent).select("key", "n", "class")), [r.key for r in top])
    size = SYMBOLS + CLASSES + 1
    pairs = np.zeros((2, size, size))
    cells = checkpointed(pair_cells(docs, words))
    for r in cells.filter("block < 0").collect():
        pairs[-1 - r.block].ravel()[np.frombuffer(bytes(r.codes), "<i4")] = np.frombuffer(bytes(r.ns), "<i8")
    masses = words.mass()
    context = np.zeros((len(masses), size, BLOCK_DIMENSIONS), np.float32)
    vectors = np.zeros((len(words.keys), BLOCK_DIMENSIONS), np.float32)
    level = np.zeros((len(masses), size), np.float32)
    for block, r, q in fit_blocks(cells, words) if masses else []:
        held = np.flatnonzero(words.blocks == block)
        context[block], vectors[held] = r, q[words.places[held]]
        level[block] = -np.log(np.exp((r @ q.T).astype(float)) @ (masses[block] / masses[block].sum()))
    (near, far), unigram = fit(pairs)
    near, far = near[:, :-1], (far - unigram)[:, :-1]  # the edge is never predicted
    far = far * _blend(pairs, near, far)
    a, c = np.exp(near - near.max(1, keepdims=True)), np.exp(far - far.max(1, keepdims=True))
    norm = np.log(a @ c.T) + near.max(1)[:, None] + far.max(1)[None, :]
    outside = counts.filter(beyond(top, SYMBOLS))
    mass = np.full(CLASSES, SMOOTHING)
    for r in outside.groupBy("class").agg((F.sum("n") + F.count("*") * SMOOTHING).alias("m")).collect():
        mass[r["class"]] += r.m
    return Model(words, near.astype(np.float32), far.astype(np.float32), norm.astype(np.float32), mass, context, vectors, level), frequent


def _blend(pairs: np.ndarray, near: np.ndarray, far: np.ndarray) -> float:
    """Weight of the farther word, by the mean log-probability over pairs whose contexts are taken as independent."""
    n = pairs[0].sum()
    if not n:
        return 0.0
    one, two = pairs[0][:, :-1], pairs[1][:, :-1]
    best, best_value = 0.0, -np.inf
    p1, p2 = one.sum(1) / n, two.sum(1) / n
    for blend in (0.0, 0.25, 0.5, 0.75, 1.0):
        a, c = np.exp(near - near.max(1, keepdims=True)), np.exp(blend * (far - far.max(1, keepdims=True)))
        norm = np.log(a @ c.T) + near.max(1)[:, None] + blend * far.max(1)[None, :]
        value = ((one * near).sum() + blend * (two * far).sum()) / n - p1 @ norm @ p2
        if value > best_value:
            best, best_value = blend, value
    return best


def scores(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from all rows that are not held out. A null text is empty and has one token, its end. A null
    doc_id is not held out; repeated rows stay apart. With no training rows every word is unseen, and scores
    come from the smoothing alone.
    """
    training = docs.filter(fold() != 0)
    counts = checkpointed(word_counts(training))
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model, frequent = train(training, counts)
    whole = math.log(total + SMOOTHING * (types + 1))
    tail = counts.filter(~frequent)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts):
        m = shared.value
        keys, classes, owner, counts_here = _coded(texts)
        symbols, at = _symbols(keys, classes, m.words)
        one, two = _contexts(symbols, counts_here, SYMBOLS + CLASSES)
        logs = m.near[one, symbols].astype(float) + m.far[two, symbols] - m.norm[one, two]
        classed = symbols >= SYMBOLS
        logs[classed] -= np.log(m.class_mass[symbols[classed] - SYMBOLS])
        logs += m.within(at, one)
        found = at >= 0
        c = np.where(found, m.words.counts[at], 0) if len(m.words.keys) else np.zeros(len(keys), np.int64)
        smooth = np.log(c + SMOOTHING)
        n = len(texts)
        rest: list[list[dict]] = [[] for _ in texts]
        rare = ~found
        pairs, times = np.unique(np.stack([owner[rare], keys[rare]]), axis=1, return_counts=True)
        for i, k, t in zip(pairs[0].tolist(), pairs[1].tolist(), times.tolist(), strict=True):
            rest[i].append({"key": k, "times": t})
        base = np.bincount(owner[found], smooth[found] - whole, n)  # differences first: sums of logs would lose digits
        own = np.bincount(owner, logs, n) + np.bincount(owner[found & classed], smooth[found & classed], n)
        return {"id": ids, "n_tokens": counts_here, "n_known": np.bincount(owner[found], minlength=n), "base": base, "own": own,
                "rest": rest}

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = checkpointed(map_texts(
        docs, run, f"id {kind}, n_tokens long, n_known long, base double, own double, rest array<struct<key: long, times: long>>"
    ).withColumn("row", F.monotonically_increasing_id()))  # numbered once, as written
    rare = scored.select("row", F.inline("rest")).join(tail.select("key", "n"), "key", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("seen"),
        F.sum(F.col("times") * (F.log(F.coalesce("n", F.lit(0)) + SMOOTHING) - whole)).alias("logs"),
        F.sum("times").alias("times"))
    logs = F.coalesce("logs", F.lit(0.0))
    ten = math.log(10)
    return scored.join(rare, "row", "left").select(
        F.col("id").alias("doc_id"), (fold("id") == 0).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        ((F.col("base") + logs) / ten).alias("base_score"),
        ((F.col("own") + logs + F.coalesce("times", F.lit(0)) * whole) / ten).alias("score"))
