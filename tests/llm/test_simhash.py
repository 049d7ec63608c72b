"""SimHash groups against a pairwise check, and the covering guarantee."""

import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cohortspan.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 3:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == slow_components(fps)


def test_every_close_pair_shares_a_key():
    masks = [m & (2**64 - 1) for m in simhash.cover(list(range(64)))]
    assert len(masks) == 15
    rng = random.Random(1)
    for _ in range(2000):
        differing = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(m & differing == 0 for m in masks)


def test_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    check(spark, texts)


def test_odd_texts(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    near = [" ".join(base[:i] + ["new"] + base[i + 1:]) for i in range(0, 300, 7)]
    check(spark, [None, "", " \t", "One", "one", "TWO words", "É é É", " ".join(base) * 40, *near, *near[:3]])


def test_crowded_buckets_are_dealt_again(spark):
    """One bucket with thousands of fingerprints that vary in few bits."""
    rng = random.Random(3)
    fps = list({rng.getrandbits(9) | rng.getrandbits(5) << 20 | 5 << 40 for _ in range(1200)})
    rows = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = [(r.a, r.b) for r in simhash.links(rows).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in edges)
    place = {f: i for i, f in enumerate(fps)}
    root = np.arange(len(fps))
    before = None
    while before is None or (before != root).any():
        before = root.copy()
        for a, b in edges:
            root[place[a]] = root[place[b]] = min(root[place[a]], root[place[b]])
    want = slow_components(fps)
    assert len(set(want)) == len(set(root)) and len(set(zip(want, root, strict=True))) == len(set(want))


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "q r s t u")], "doc_id long, text string")
    rows = simhash.near_duplicates(docs).orderBy(F.col("doc_id").asc_nulls_last()).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [
        ("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
