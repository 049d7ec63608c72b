"""Language-model scores: base scores against plain counts, a normalised and better model, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortspan.llm import language_model as L


def plain(docs):
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs}
    tokens = [(d, [*(t or "").encode().lower().split(), b""]) for d, t in docs]
    counts = Counter(w for d, words in tokens if not held[d] for w in words)
    total = sum(counts.values())
    below = math.log10(total + 0.1 * (len(counts) + 1))
    return [(str(d), held[d], len(words), sum(w in counts for w in words), total,
             sum(math.log10(counts[w] + 0.1) - below for w in words)) for d, words in tokens]


def check(spark, docs):
    rows = L.scores(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS key")).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
    want = sorted(plain(docs))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    return rows


@pytest.mark.parametrize("head", [1 << 19, 2000])
def test_documents(spark, monkeypatch, head):
    monkeypatch.setattr(L, "HEAD", head)
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows = check(spark, docs)
    held = [r for r in rows if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    print("held out, log10 per token: base", sum(r.base_score for r in held) / tokens, "model", sum(r.score for r in held) / tokens)
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * tokens


@pytest.fixture
def small_blocks(monkeypatch):
    """Bounds that only the driver reads."""
    monkeypatch.setattr(L, "LEAST", 5)
    monkeypatch.setattr(L, "BLOCK", 64)


def paired(n=3000):
    """Texts in which the word before tells the next one of the same ending."""
    rng = np.random.default_rng(1)
    leads = [f"lead{i}" for i in range(8)]
    pick = rng.integers(0, 8, (n, 12))
    return [" ".join(f"{leads[a]} {'bcdfghjk'[a]}{'aeiou'[rng.integers(5)]}{'lmnrst'[rng.integers(6)]}{'aeiou'[rng.integers(5)]}ing" for a in row) for row in pick]


def log_probability(m, every, words):
    """Of one text, from the model's vectors, word by word."""
    symbol = {k: s for k, s in zip(m.words.keys.tolist(), m.words.symbols.tolist(), strict=True) if s >= 0}
    place = {k: i for i, k in enumerate(m.words.keys.tolist())}
    counts = dict(zip(every["key"], every["n"], strict=True))
    total, one, two = 0.0, L.SYMBOLS + L.CLASSES, L.SYMBOLS + L.CLASSES
    for word in words:
        k = L.word_key(word)
        s = symbol.get(k, L.SYMBOLS + L.ending_class(word))
        scores = m.near[one].astype(float) + m.far[two]
        total += scores[s] - math.log(np.exp(scores).sum())
        if s >= L.SYMBOLS:
            mass = m.class_mass[s - L.SYMBOLS]
            b = m.words.blocks[place[k]] if k in place else -1
            if b < 0:
                total += math.log((counts.get(k, 0) + 0.1) / mass)
            else:
                mates = np.flatnonzero(m.words.blocks == b)
                share = m.words.counts[mates] + 0.1
                odds = share * np.exp(m.vectors[mates].astype(float) @ m.context[b, one])
                total += math.log(share.sum() / mass * odds[mates.tolist().index(place[k])] / odds.sum())
        one, two = s, one
    return total


def test_scores_word_by_word(spark, small_blocks):
    docs = spark.createDataFrame(list(enumerate([*paired(), None, "new lead0 bal", "x"])), "doc_id long, text string")
    training = docs.filter(L.fold() != 0)
    counts = L.word_counts(training).cache()
    every = counts.toPandas()
    m, _ = L.train(training, counts)
    assert (m.words.blocks >= 0).sum() > 50 and np.bincount(m.words.blocks[m.words.blocks >= 0]).max() <= L.BLOCK
    assert np.abs(m.context).max() > 0.1  # the word before was found to tell
    rows = {r.doc_id: r for r in L.scores(docs).collect()}
    texts = dict(docs.collect())
    gain = 0.0
    for d in [*range(0, 400, 7), 3000, 3001, 3002]:
        words = L.words_of((texts[d] or "").encode())
        want = log_probability(m, every, words)
        assert math.isclose(rows[d].score * math.log(10), want, rel_tol=1e-4, abs_tol=1e-3)
    held = [r for r in rows.values() if r.held_out]
    m.level, m.context = m.level * 0, m.context * 0
    for r in held[:50]:
        gain += r.score * math.log(10) - log_probability(m, every, L.words_of((texts[r.doc_id] or "").encode()))
    assert gain > 0.1 * sum(r.n_tokens for r in held[:50])  # the vectors tell unseen texts' words


def test_probabilities_sum_to_one(spark, small_blocks):
    docs = spark.createDataFrame([(t,) for t in paired()], "text string")
    counts = L.word_counts(docs).cache()
    m, _ = L.train(docs, counts)
    every = counts.toPandas()
    symbols, at = L._symbols(every["key"].to_numpy(), every["class"].to_numpy(np.int64), m.words)
    for one, two in ((3, 4), (L.SYMBOLS + 2, 0), (L.SYMBOLS + L.CLASSES, L.SYMBOLS + L.CLASSES)):
        p = np.exp(m.near[one].astype(float) + m.far[two] - m.norm[one, two])
        assert abs(p.sum() - 1) < 1e-4
        share = np.where(symbols < L.SYMBOLS, 1.0, (every["n"] + 0.1) / m.class_mass[np.maximum(0, symbols - L.SYMBOLS)])
        share = share * np.exp(m.within(at, np.full(len(at), one)))
        unseen = (p[L.SYMBOLS:] * 0.1 / m.class_mass).sum()
        unused = p[:L.SYMBOLS].sum() - p[np.unique(symbols[symbols < L.SYMBOLS])].sum()
        assert abs((p[symbols] * share).sum() + unseen + unused - 1) < 1e-4


def test_vocabulary_grows_with_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    sizes = []
    for part in (docs.filter("doc_id % 4 = 0"), docs):
        keys, n, classes = L.packed(L.word_counts(part))
        sizes.append(int((L.vocabulary(keys, n, classes, []).blocks >= 0).sum()))
    assert sizes[1] > 2 * sizes[0] > 0


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (None, "a b A"), (3, "É é x"), (3, "x x"), (3, "x x"), (5, "y " * 50_000), (23, "new words")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.scores(empty).count() == 0
    only_held = [(d, "some words") for d in range(200) if zlib.crc32(str(d).encode()) % 10 == 0]
    check(spark, only_held)
