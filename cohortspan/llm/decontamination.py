"""Benchmark decontamination by winnowing.

Of every nine consecutive 5-word grams (13 words) the one with the least hash is kept, in documents and in
benchmark items alike, so whatever 13 words they share, they share a kept gram at the same place. Kept grams
are joined, and each hit is extended word by word to both sides. Items of fewer than 13 words are one window
each, compared whole.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, _slices, bit_table, checkpointed, flatten, map_batches, passes, sliding_argmin

WINDOW = 13
GRAM = 5
SHARE_OF_WORDS = 20  # contaminated: hit words times this reach the document's words

_SPACE = b" "
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
assert bytes(string.ascii_uppercase, "ascii").translate(_FOLD) == bytes(string.ascii_lowercase, "ascii")

_CANDIDATES = "array<struct<h: bigint, pos: int, left: int, words: binary>>"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all characters beyond ASCII."""
    return text.translate(_FOLD).split()


def _kept_grams(rolling: RollingHash, starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept grams of all texts; no gram spans two texts."""
    grams = rolling.grams(GRAM)
    least = sliding_argmin(grams, WINDOW - GRAM + 1)
    whole = np.arange(len(least)) + WINDOW <= starts[owner[:len(least)] + 1]
    kept = np.unique(least[whole])
    return kept, grams[kept]


def _rows(words: list[bytes], first: int, positions: list[int], hashes: list[int], length: int) -> list[dict]:
    """Candidates of one text at the given positions of the flat array; ``length`` 0 stands for kept grams."""
    out = []
    for at, h in zip(positions, hashes, strict=True):
        at -= first
        low, high = (at, at + length) if length else (max(0, at - WINDOW + GRAM), at + WINDOW)
        out.append({"h": h, "pos": at, "left": at - low, "words": _SPACE.join(words[low:high])})
    return out


def _candidates(texts: list[bytes], lengths: list[int], admitted: bytes | None, whole_only: bool):
    """Word counts and candidates of each text; ``admitted`` is the bit table, None to keep all."""
    lists = [words_of(t) for t in texts]
    hashes, owner, starts = flatten(lists)
    found: list[list[dict]] = [[] for _ in texts]

    def take(positions: np.ndarray, values: np.ndarray, length: int) -> None:
        if admitted is not None:
            passed = passes(values, admitted)
            positions, values = positions[passed], values[passed]
        owners = owner[positions]
        cuts = np.flatnonzero(np.diff(owners)) + 1
        signed = values.view(np.int64)
        for p, v in zip(np.split(positions, cuts), np.split(signed, cuts), strict=True):
            if len(p):
                i = int(owner[p[0]])
                found[i] += _rows(lists[i], int(starts[i]), p.tolist(), v.tolist(), length)

    rolling = RollingHash(hashes)
    take(*_kept_grams(rolling, starts, owner), 0)
    for length in lengths:
        grams = rolling.grams(length) ^ np.uint64(length)  # apart from kept grams
        at = np.arange(len(grams))
        inside = at + length <= starts[owner[:len(grams)] + 1]
        if whole_only:
            inside &= (at == starts[owner[:len(grams)]]) & (at + length == starts[owner[:len(grams)] + 1])
        take(at[inside], grams[inside], length)
    return [len(w) for w in lists], found


def _scan(df: DataFrame, lengths: list[int], bits: bytes | None, whole_only: bool) -> DataFrame:
    """(id, key, n_words, candidates) of every row of (id, key, text)."""
    table = None if bits is None else df.sparkSession.sparkContext.broadcast(bits)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        admitted = None if table is None else table.value
        entry = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("words", pa.binary())]))
        for batch in batches:
            pairs = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(2)], names=["i", "text"])
            for rows, texts in _slices(pairs):
                counts, found = _candidates(texts, lengths, admitted, whole_only)
                here = batch.slice(rows[0], len(rows))
                yield pa.RecordBatch.from_arrays(
                    [here.column(0), here.column(1), pa.array(counts, pa.int64()), pa.array(found, entry)],
                    names=["id", "key", "n_words", "candidates"])

    kind = df.schema["id"].dataType.simpleString()
    return map_batches(df.select("id", "key", "text"), run, f"id {kind}, key bigint, n_words bigint, candidates {_CANDIDATES}")


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of joined candidates keep those whose common words fill a window, with the words' range."""
    for batch in batches:
        keep, begins, ends = [], [], []
        columns = [batch.column(name).to_pylist() for name in ("pos", "left", "words", "item_left", "item_words", "gram")]
        for i, (pos, left, words, item_left, item_words, gram) in enumerate(zip(*columns, strict=True)):
            a, b = words.split(_SPACE), item_words.split(_SPACE)
            if gram == 0:
                if a == b:
                    keep.append(i)
                    begins.append(pos)
                    ends.append(pos + len(a))
                continue
            if a[left:left + gram] != b[item_left:item_left + gram]:
                continue
            before = after = 0
            while before < min(left, item_left) and a[left - 1 - before] == b[item_left - 1 - before]:
                before += 1
            a_end, b_end = left + gram, item_left + gram
            while after < min(len(a) - a_end, len(b) - b_end) and a[a_end + after] == b[b_end + after]:
                after += 1
            if before + gram + after >= WINDOW:
                keep.append(i)
                begins.append(pos - before)
                ends.append(pos + gram + after)
        kept = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [kept.column("id"), kept.column("key"), kept.column("item"), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())],
            names=["id", "key", "item", "begin", "end"])


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with what it shares with ``benchmark`` (item_id, text).

    doc_id, text_key (hash of the text), n_words, n_hit, n_items, items_sha256, contaminated. Null texts have
    no words. Items with no words are nowhere; a null item_id hits words but is not listed or counted.
    Repeated rows and a null doc_id are kept as they are; rows are told apart by doc_id and text.
    """
    texts = checkpointed(benchmark.select("item_id", F.xxhash64("text").alias("item")))
    # Equal item texts are looked for once.
    items = checkpointed(_scan(
        benchmark.filter("text IS NOT NULL").select(F.xxhash64("text").alias("id"), F.lit(0).cast("long").alias("key"), "text")
        .dropDuplicates(["text"]), list(range(1, WINDOW)), None, True))
    lengths = [r[0] for r in items.filter(F.col("n_words").between(1, WINDOW - 1)).select("n_words").distinct().collect()]
    parts = checkpointed(items.select("id", "n_words", F.explode("candidates").alias("c")).select(
        F.col("id").alias("item"), F.col("c.h").alias("h"), F.col("c.left").alias("item_left"),
        F.col("c.words").alias("item_words"), F.when(F.col("n_words") < WINDOW, 0).otherwise(GRAM).alias("gram")).distinct())
    scanned = checkpointed(_scan(
        docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text"), sorted(lengths), bit_table(parts), False))
    tried = scanned.filter(F.size("candidates") > 0).select("id", "key", F.explode("candidates").alias("c")).select(
        "id", "key", F.col("c.h").alias("h"), F.col("c.pos").alias("pos"), F.col("c.left").alias("left"), F.col("c.words").alias("words"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = checkpointed(tried.join(parts, "h").mapInArrow(
        _extend, f"id {kind}, key bigint, item bigint, begin int, end int").distinct())
    reach = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("begin", "end"))), reach,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["begin"], acc["to"]))).cast("long").alias("n"),
            F.greatest(acc["to"], x["end"]).alias("to")))["n"]
    by_doc = spans.groupBy("id", "key").agg(covered.alias("n_hit"))
    named = spans.select("id", "key", "item").distinct().join(texts, "item").groupBy("id", "key").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    result = by_doc.join(named, [by_doc.id.eqNullSafe(named.id), by_doc.key == named.key]).select(
        by_doc.id.alias("_id"), by_doc.key.alias("_key"), "n_hit", "items")
    result = checkpointed(result)
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return scanned.join(result, [F.col("id").eqNullSafe(F.col("_id")), F.col("key") == F.col("_key")], "left").select(
        F.col("id").alias("doc_id"), F.col("key").alias("text_key"), "n_words", n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * SHARE_OF_WORDS >= F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that are contaminated."""
    bad = checkpointed(hits(docs, benchmark).filter("contaminated").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct())
    return docs.join(bad, [docs.doc_id.eqNullSafe(F.col("_id")), F.xxhash64(docs.text) == F.col("_key")], "left_anti")
