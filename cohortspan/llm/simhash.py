"""Near duplicates by SimHash, found with covering locality-sensitive hashing.

Bit positions are dealt to the nonzero vectors of GF(2)^(r+1). Each nonzero vector v gives one table,
whose mask keeps the positions with odd inner product with v. Any r positions span at most r of the
r+1 dimensions, so some v is orthogonal to all of them: every pair within radius r agrees on the whole
key of some table. Nothing is sampled and no bucket is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, map_texts

SEED = 42
SHINGLE = 3
RADIUS = 3
BUCKET_ROWS = 256  # a bucket above this is dealt again over its own varying bits


def fingerprint(text: bytes, shingle: int = SHINGLE, chunk: int = 1 << 16) -> int:
    """64-bit SimHash: a bit is set if it is set in more than half of the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, chunk):
        part = words[at:at + chunk + shingle - 1]
        grams = map(b" ".join, zip(*(part[j:] for j in range(shingle)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp) of every row; fp holds the 64 bits as a signed long, text_key is the text's hash."""
    def run(ids, texts):
        return {"id": ids, "fp": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}

    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("doc_id"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(keyed, run, f"id struct<doc_id: {kind}, text_key: bigint>, fp bigint").select("id.*", "fp")


def cover(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``bits`` such that any ``radius`` of them miss at least one mask; signed longs."""
    vectors = range(1, 1 << (radius + 1))
    masks = []
    for v in vectors:
        mask = 0
        for place, bit in enumerate(bits):
            if bin(v & (1 + place % len(vectors))).count("1") % 2:
                mask |= 1 << bit
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _star_edges(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of links among one bucket's distinct fingerprints: no component of it is lost."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    todo = np.ones(len(fps), bool)
    a, b = [], []
    while todo.any():
        front = np.zeros(len(fps), bool)
        front[np.argmax(todo)] = True
        todo &= ~front
        while front.any():
            i = np.argmax(front)
            front[i] = False
            new = near[i] & todo
            a.append(fps[new])
            b.append(np.full(int(new.sum()), fps[i]))
            front |= new
            todo &= ~new
    return np.concatenate(a), np.concatenate(b)


def links(distinct: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs (a, b) of fingerprints within ``radius`` that connect whatever all such pairs connect.

    Buckets of up to ``bucket_rows`` fingerprints are compared inside one row. A larger bucket is dealt
    again by covering masks over the bits that still vary in it, which is exact again and ends: more than
    256 distinct fingerprints vary in nine bits or more, and then every mask fixes some of those bits.
    """
    if bucket_rows < BUCKET_ROWS:
        raise ValueError(f"bucket_rows must be {BUCKET_ROWS} or more")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for fps in batch.column(0).to_pylist():
                x, y = _star_edges(np.array(fps, np.int64), radius)
                a.append(x)
                b.append(y)
            if a:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})

    def subkeys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for mask in batch.column(0).to_pylist():
                varying = mask & (2**64 - 1)
                out.append(cover([i for i in range(64) if varying >> i & 1], radius))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(out, pa.list_(pa.int64()))], names=["tab", "key", "masks"])

    masks = cover(list(range(64)), radius)
    rows = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks]))).select(
        "fp", F.col("pos").cast("long").alias("tab"), F.col("col").alias("key"))
    found = []
    while True:
        hot = checkpointed(rows.groupBy("tab", "key").agg(
            F.count("*").alias("n"), F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("varying"),
            F.min("fp").alias("least"),
        ).filter(F.col("n") > bucket_rows))
        cold = rows.join(hot, ["tab", "key"], "left_anti").groupBy("tab", "key").agg(F.collect_list("fp").alias("fps"))
        found.append(checkpointed(
            cold.filter(F.size("fps") > 1).select("fps").mapInArrow(compare, "a long, b long").distinct()))
        if hot.isEmpty():
            break
        dealt = hot.filter(F.bit_count("varying") > radius).select("varying", "tab", "key").mapInArrow(
            subkeys, "tab long, key long, masks array<long>")
        close = hot.filter(F.bit_count("varying") <= radius).select("tab", "key", "least")
        found.append(checkpointed(
            rows.join(close, ["tab", "key"]).select(F.col("fp").alias("a"), F.col("least").alias("b")).filter("a <> b")))
        rows = checkpointed(
            rows.join(dealt, ["tab", "key"]).select("fp", "tab", "key", F.posexplode("masks")).select(
                "fp", F.xxhash64("tab", "key", "pos").alias("tab"), F.col("fp").bitwiseAND(F.col("col")).alias("key")))
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionAll(more)
    return edges


def _grouped(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of every row, and (fp, root, component_id) of every fingerprint."""
    marked = checkpointed(fingerprints(docs, shingle))
    classes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    nodes = connected_components(links(classes, radius))
    members = checkpointed(classes.join(nodes, classes.fp == nodes.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")))
    firsts = members.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked, checkpointed(members.join(firsts, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits.
    A null or empty text has fingerprint zero and is linked like any other. Rows with a null doc_id are
    kept; they can link others and take the component's smallest known doc_id (null if there is none).
    Repeated rows stay repeated. Other columns of ``docs`` are not looked at.
    """
    marked, named = _grouped(docs, shingle, radius)
    return marked.join(named.drop("root"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def distinct_documents(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest doc_id's, known ids first.

    Of rows that share this doc_id too, the one with the smallest text hash stays, and one of equal rows.
    """
    marked, named = _grouped(docs, shingle, radius)
    rows = checkpointed(marked.join(named, "fp").groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n")))
    at = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    chosen = checkpointed(rows.groupBy("root").agg(F.min_by(F.struct("doc_id", "text_key", "n"), at).alias("x")).select(
        "root", F.col("x.doc_id").alias("_id"), F.col("x.text_key").alias("_key"), F.col("x.n").alias("_n")))
    same = [F.col("doc_id").eqNullSafe(F.col("_id")), F.col("text_key") == F.col("_key")]
    gone = checkpointed(rows.join(chosen, ["root"]).filter(~(same[0] & same[1])).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")))
    several = checkpointed(chosen.filter("_n > 1").select("_id", "_key"))
    same = [docs.doc_id.eqNullSafe(F.col("_id")), F.xxhash64(docs.text) == F.col("_key")]
    kept = docs.join(gone, same, "left_anti")
    if several.isEmpty():
        return kept
    again = kept.join(several, same, "left_semi")
    return kept.join(several, same, "left_anti").unionByName(again.withColumn("_key", F.xxhash64("text")).dropDuplicates(
        ["doc_id", "_key"]).drop("_key"))
