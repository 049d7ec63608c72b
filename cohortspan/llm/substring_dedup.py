"""Long repeated word spans, by compacting a sampled de Bruijn graph.

Edges of the graph are k-mers of words. Of the k-mers in every window the one with the least hash is taken,
so two equal windows take the same k-mer at the same place. A k-mer that occurs in several documents is
joined to its occurrences; where all occurrences agree on the text up to the next (and the previous) taken
k-mer the path does not branch, and such paths compact to one span per document. All windows inside such a
span have the same documents, so its first document decides for all of them. Windows that reach over a branch
are compared by their own 128-bit content hash at their coordinates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, _slices, bit_table, checkpointed, flatten, map_batches, passes, sliding_argmin

WINDOW = 50
KMER = 10
FIRST, LAST = 1, 2  # a taken k-mer is its document's first or last one

_START, _END = np.uint64(0x53544152), np.uint64(0x454E4421)
_TAKEN = "array<struct<h: bigint, link: bigint, back: bigint, at: bigint>>"
_TAKEN_TYPE = pa.list_(pa.struct([(name, pa.int64()) for name in ("h", "link", "back", "at")]))


def _windows(lists: list[list[bytes]]):
    """Rolling hash, text number and bounds of the flat words; the windows and the k-mer that each takes."""
    hashes, owner, starts = flatten(lists)
    rolling = RollingHash(hashes)
    kmers = rolling.grams(KMER)
    least = sliding_argmin(kmers, WINDOW - KMER + 1)
    at = np.flatnonzero(np.arange(len(least)) + WINDOW <= starts[owner[:len(least)] + 1])
    return rolling, kmers, owner, starts, at, least[at]


def _taken(lists: list[list[bytes]]) -> list[list[dict]]:
    """Each text's taken k-mers with the hashes of the text to the next and from the previous one."""
    rolling, kmers, owner, starts, _, least = _windows(lists)
    out: list[list[dict]] = [[] for _ in lists]
    at = np.unique(least)
    if not len(at):
        return out
    text = owner[at]
    begin, end = starts[text], starts[text + 1]
    first = np.concatenate(([True], text[1:] != text[:-1]))
    last = np.concatenate((first[1:], [True]))
    after, before = np.roll(at, -1), np.roll(at, 1)
    link = rolling.spans(at, np.where(last, end, after + KMER)) ^ np.where(last, _END, np.uint64(0))
    back = rolling.spans(np.where(first, begin, before), at + KMER) ^ np.where(first, _START, np.uint64(0))
    place = (at - begin << 33) + (end - begin << 2) + first * FIRST + last * LAST
    columns = [x.view(np.int64).tolist() for x in (kmers[at], link, back)] + [place.tolist()]
    for i, h, f, b, p in zip(text.tolist(), *columns, strict=True):
        out[i].append({"h": h, "link": f, "back": b, "at": p})
    return out


def _rows_with_text(batches: Iterator[pa.RecordBatch], text: int):
    """(rows, texts) of batches, cut so that long texts do not pile up."""
    for batch in batches:
        pairs = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(text)], names=["i", "text"])
        for rows, texts in _slices(pairs):
            yield batch.slice(rows[0], len(rows)), texts


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for here, texts in _rows_with_text(batches, 2):
        lists = [t.split() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [here.column(0), here.column(1), pa.array(map(len, lists), pa.int64()),
             pa.array([hashlib.sha256(b" ".join(words)).hexdigest() for words in lists]), pa.array(_taken(lists), _TAKEN_TYPE)],
            names=["doc", "key", "n_words", "sha", "taken"])


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: spans of unbranched repeated paths as ranges of window starts, and what they leave open."""
    spans_type = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64()), ("repeated", pa.bool_())]))
    for batch in batches:
        spans, repeats, open_ = [], [], []
        for doc, taken in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            taken.sort(key=lambda k: k["at"])
            runs, previous = [], None
            for k in taken:
                pos, n, edge = k["at"] >> 33, k["at"] >> 2 & (1 << 31) - 1, k["at"] & 3
                low = 0 if edge & FIRST and k["straight_back"] else pos
                high = n if edge & LAST and k["straight"] else pos + KMER
                if previous and previous["straight"] and k["straight_back"] and previous["link"] == k["back"]:
                    runs[-1][1] = high
                else:
                    runs.append([low, high, k["first"] < doc])
                previous = k
            spans.append([{"low": a, "high": b - WINDOW, "repeated": r} for a, b, r in runs if b - a >= WINDOW])
            repeats.append([k["at"] >> 33 for k in taken])
            n = taken[0]["at"] >> 2 & (1 << 31) - 1
            wanted, settled = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
            for pos in repeats[-1]:
                wanted[max(0, pos + KMER - WINDOW):min(pos, n - WINDOW) + 1] = True
            for span in spans[-1]:
                settled[span["low"]:span["high"] + 1] = True
            open_.append(bool((wanted & ~settled).any()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(spans, spans_type), pa.array(repeats, pa.list_(pa.int64())), pa.array(open_)],
            names=["doc", "key", "spans", "repeats", "open"])


def _open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content hashes of the windows whose k-mer repeats and that no compacted span holds."""
    for here, texts in _rows_with_text(batches, 2):
        rolling, _, owner, starts, at, least = _windows([t.split() for t in texts])
        repeated = np.zeros(len(owner) + 1, bool)
        settled = np.zeros(len(owner) + 1, bool)
        for i, (spans, repeats) in enumerate(zip(here.column(3).to_pylist(), here.column(4).to_pylist(), strict=True)):
            repeated[starts[i] + np.array(repeats, np.int64)] = True
            for span in spans:
                settled[starts[i] + span["low"]:starts[i] + span["high"] + 1] = True
        at = at[repeated[least] & ~settled[at]]
        text = owner[at]
        second = RollingHash(rolling.hashes, second=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rolling.spans(at, at + WINDOW).view(np.int64)), pa.array(second.spans(at, at + WINDOW).view(np.int64)),
             here.column(0).take(pa.array(text)), here.column(1).take(pa.array(text)), pa.array(at - starts[text])],
            names=["w1", "w2", "doc", "key", "pos"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of the given windows (ranges of window starts)."""
    for here, texts in _rows_with_text(batches, 2):
        removed, shas, kept_texts = [], [], []
        for text, ranges in zip(texts, here.column(3).to_pylist(), strict=True):
            words = text.split()
            gone = np.zeros(len(words), bool)
            for r in ranges:
                gone[r["low"]:r["high"] + WINDOW] = True
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
            removed.append(int(gone.sum()))
            shas.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept.decode(errors="replace"))
        yield pa.RecordBatch.from_arrays(
            [here.column(0), here.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept_texts, pa.string())],
            names=["doc", "key", "n_removed", "sha", "kept"])


def _some_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts of about the documents in ``rows`` (doc, key): what a bit table of fixed size lets through."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(rows.select(F.xxhash64("doc", "key").alias("h"))))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(np.asarray(batch.column(3)).view(np.uint64), table.value)))

    return map_batches(
        docs.withColumn("h", F.xxhash64("doc", "key")).select("doc", "key", "text", "h"), run, "doc long, key long, text string, h long").drop("h")


def repeated_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (doc, key, text): the scan (doc, key, n_words, sha), and (doc, key, ranges) for documents with
    windows that also start in a document with a smaller id."""
    scan = checkpointed(map_batches(
        docs.select("doc", "key", "text"), _scan, f"doc long, key long, n_words long, sha string, taken {_TAKEN}"))
    taken = scan.filter("doc IS NOT NULL").select("doc", "key", F.inline("taken"))
    several = checkpointed(taken.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("other")).filter(
        "first < other").select("h", "first"))
    found = checkpointed(taken.join(several, "h").distinct())  # a repeated row has the same k-mers at the same places
    straight = checkpointed(found.groupBy("h").agg(
        (F.min("link") == F.max("link")).alias("straight"), (F.min("back") == F.max("back")).alias("straight_back")))
    paths = checkpointed(found.join(straight, "h").groupBy("doc", "key").agg(F.collect_list(F.struct(
        "at", "first", "link", "back", "straight", "straight_back")).alias("taken")).mapInArrow(
        _compact, "doc long, key long, spans array<struct<low: bigint, high: bigint, repeated: boolean>>, "
                  "repeats array<bigint>, open boolean"))
    branching = paths.filter("open")
    windows = checkpointed(_some_texts(docs, branching).dropDuplicates(["doc", "key"]).join(branching, ["doc", "key"]).select(
        "doc", "key", "text", "spans", "repeats").mapInArrow(_open_windows, "w1 long, w2 long, doc long, key long, pos long"))
    firsts = windows.groupBy("w1", "w2").agg(F.min("doc").alias("first"), F.max("doc").alias("other")).filter("first < other")
    over_branches = windows.join(checkpointed(firsts), ["w1", "w2"]).filter("first < doc").select(
        "doc", "key", F.col("pos").alias("low"), F.col("pos").alias("high"))
    inside = paths.select("doc", "key", F.inline("spans")).filter("repeated").select("doc", "key", "low", "high")
    ranges = checkpointed(over_branches.unionAll(inside).groupBy("doc", "key").agg(
        F.collect_list(F.struct("low", "high")).alias("ranges")))
    return scan.drop("taken"), ranges


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    A word goes if some window of 50 words around it also starts in a document with a smaller doc_id. Null
    texts have no words. A null doc_id is never smaller nor larger, so its text is kept and removes nothing.
    Rows that share a doc_id remove nothing from each other; they are told apart by their texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("key"), "text")
    scan, ranges = repeated_ranges(docs)
    changed = checkpointed(_some_texts(docs, ranges).dropDuplicates(["doc", "key"]).join(ranges, ["doc", "key"]).select(
        "doc", "key", "text", "ranges").mapInArrow(
        _without, "doc long, key long, n_removed long, sha string, kept string").select(
        "doc", "key", "n_removed", F.col("sha").alias("new_sha")))
    return scan.join(changed, ["doc", "key"], "left").select(
        F.col("doc").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("new_sha", "sha").alias("kept_sha256"))
