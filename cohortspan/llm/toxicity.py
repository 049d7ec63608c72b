"""Toxicity of texts: boosted trees over dense features, calibrated by isotonic regression.

Labels are learned from rows whose crc32(doc_id as text) mod 5 is not 0. Of those, at most about
``SAMPLE_ROWS`` (chosen by hash) are used: the words that mark toxic texts among them form a lexicon, next to
a short fixed one, and the features and trees are fitted on them, one part being kept for calibration.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit_trees, isotonic, sigmoid
from .common import checkpointed, map_batches, map_texts

FOLDS = 5
SAMPLE_ROWS = 30_000
LEXICON_WORDS = 400
EVIDENCE = 18.0  # least log-likelihood ratio of a lexicon word
NEAR = 4  # words to either side in which a second person counts as near
BLEND = 0.02  # share of the uncalibrated score, which keeps calibrated ties in order

# Common insults, and second-person words of four languages.
INSULTS = frozenset("idiot idiots moron morons stupid dumb trash garbage scum loser losers worthless pathetic disgusting "
                    "clown filth vermin hate ugly freak shut kill".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus "
                          "usted ustedes vosotros".split())
EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»¡¿…“”‘’"
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
OBFUSCATED = re.compile(r"[^\W\d_][0-9@$*!#]+[^\W\d_]")
LONG_REPEAT = re.compile(r"(\S)\1{3,}")

_KIND = np.zeros(256, np.uint8)  # 1 capital, 2 punctuation, 3 digit, 4 exclamation mark
_KIND[65:91] = 1
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_KIND[48:58] = 3
_KIND[33] = 4

FEATURES = ("log_words", "insults", "lexicon", "lexicon_hits", "lexicon_distinct", "lexicon_weight", "heaviest", "near_second_person",
            "second_person", "capitals", "capital_words", "punctuation", "exclamation", "digits", "obfuscated", "hidden_hits", "repeats")


def plain_words(text: str) -> list[str]:
    return [w.strip(EDGE) for w in text.lower().split()]


def features(text: bytes, lexicon: dict[str, float]) -> list[float]:
    decoded = text.decode(errors="replace")
    raw = decoded.split()
    words = plain_words(decoded)
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in lexicon or w in INSULTS]
    weights = [lexicon.get(words[i], 0.0) for i in hits]
    second = sum(w in SECOND_PERSON for w in words)
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR):i + NEAR + 1]) for i in hits)
    odd = [m for m in raw if not m.isalpha() and OBFUSCATED.search(m)]
    hidden = sum((w := m.lower().translate(LOOKALIKE).strip(EDGE)) in lexicon or w in INSULTS for m in odd)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=5) / max(1, len(text))
    return [
        np.log1p(len(words)), sum(words[i] in INSULTS for i in hits) / n, sum(w > 0 for w in weights) / n, np.log1p(len(hits)),
        np.log1p(len({words[i] for i in hits})), sum(weights) / n, max(weights, default=0.0), near / max(1, len(hits)), second / n,
        kinds[1], sum(w.isupper() and len(w) > 1 for w in raw) / n, kinds[2] + kinds[4], kinds[4], kinds[3], len(odd) / n,
        hidden / n, len(LONG_REPEAT.findall(decoded)) / n,
    ]


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    scores: np.ndarray
    rates: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x)
        return np.clip((1 - BLEND) * np.interp(raw, self.scores, self.rates) + BLEND * sigmoid(raw), 0.0, 1.0)


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo the folds; a null id is in fold 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)), F.lit(1)).cast("int")


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, y) of training rows: all if they are at most ``rows``, else about so many by hash.

    Copies of a text under one doc_id are one row. Ids are bounded first, then the texts that they bring.
    """
    def bounded(df: DataFrame, n: int, *key: str) -> DataFrame:
        place = F.pmod(F.xxhash64(F.lit("toxicity"), *key), F.lit(1 << 30))
        return df.filter(place <= int(min(1.0, rows / max(1, n)) * (1 << 30)))

    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("y")).filter(fold() != 0)
    chosen = bounded(known, known.count(), "doc_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("text"))
    found = texts.select("doc_id", "h").distinct().count()
    return checkpointed(bounded(texts, found, "doc_id", "h").groupBy("doc_id", "h").agg(
        F.first("text").alias("text"), F.first("y").alias("y")).select("doc_id", "text", "y"))


def _lexicon(sample: DataFrame) -> dict[str, float]:
    """Words that occur in toxic texts far more than in others, with their log odds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, int], int] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in set(plain_words(text or "")):
                    if 1 < len(w) <= 40:
                        counts[w, y] = counts.get((w, y), 0) + 1
            yield pa.RecordBatch.from_pydict({
                "word": pa.array([w for w, _ in counts], pa.string()), "y": pa.array([y for _, y in counts], pa.int32()),
                "n": pa.array(counts.values(), pa.int64())})

    ones, total = sample.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    if not ones or ones == total:
        return {}
    a, b = F.col("a"), F.col("b")
    words = map_batches(sample.select("text", F.col("y").cast("int").alias("y")), run, "word string, y int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b")).filter("a > 3")
    rate = ones / total
    term = lambda seen, due: F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)
    both = a + b
    words = words.withColumn("g2", 2 * (term(a, both * rate) + term(b, both * (1 - rate)))).withColumn(
        "weight", F.log((a + 0.5) / (ones + 1)) - F.log((b + 0.5) / (total - ones + 1)))
    top = words.filter((F.col("g2") >= EVIDENCE) & (F.col("weight") > 1.5)).orderBy(F.desc("g2"), "word").limit(LEXICON_WORDS)
    return {r.word: round(r.weight, 4) for r in top.collect()}


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    sample = _sample(docs, labels, sample_rows)
    lexicon = _lexicon(sample)
    names = ", ".join(f"f{i} double" for i in range(len(FEATURES)))

    def run(ids, texts):
        x = np.array([features(t, lexicon) for t in texts])
        return {"id": ids} | {f"f{i}": x[:, i] for i in range(x.shape[1])}

    keyed = sample.select(F.struct("doc_id", "y").alias("doc_id"), "text")
    schema = f"id struct<doc_id: {docs.schema['doc_id'].dataType.simpleString()}, y: int>, {names}"
    rows = map_texts(keyed, run, schema).withColumn("part", fold("id.doc_id")).select(
        "id.y", "part", *[f"f{i}" for i in range(len(FEATURES))]).orderBy("id.doc_id").toPandas()
    y, part = rows["y"].to_numpy(float), rows["part"].to_numpy()
    x = rows.drop(columns=["y", "part"]).to_numpy(float).reshape(len(rows), len(FEATURES))
    fitting = part != FOLDS - 1
    if len(np.unique(y[fitting])) < 2 or len(np.unique(y[~fitting])) < 2:
        fitting[:] = True
    trees = fit_trees(x[fitting], y[fitting])
    held = ~fitting if not fitting.all() else fitting
    return Model(lexicon, trees, *isotonic(trees.raw(x[held]), y[held]))


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Features come from the text alone. A null text is empty. A null doc_id has no label and is not held
    out. A document with several labels counts as toxic if one says so. Without labels every score is 0.
    """
    model = train(docs, labels, sample_rows)

    def run(ids, texts):
        return {"doc_id": ids, "score": model.score(np.array([features(t, model.lexicon) for t in texts]))}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, run, f"doc_id {kind}, score double").select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns stay."""
    model = train(docs, labels)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(columns.index("text")).to_pylist()
            if texts:
                x = np.array([features((t or "").encode(), model.lexicon) for t in texts])
                yield batch.filter(pa.array(model.score(x) < 0.5))

    return map_batches(docs, run, docs.schema)
