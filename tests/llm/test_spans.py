"""Substring dedup and benchmark decontamination against plain versions."""

import random

import brute
import numpy as np
import pytest

from cohortspan.llm import common, decontamination, substring_dedup


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def source(spark, name, *columns, folder=brute.FOLDER):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()]


def removed(spark, docs):
    rows = substring_dedup.remove_repeats(table(spark, docs)).collect()
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows}


def test_rolling_hash_is_of_the_content():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 5, 400).astype(np.uint64)
    for k in (1, 3, 50):
        grams = common.RollingHash(h).grams(k)
        by = {}
        for i, g in enumerate(grams.tolist()):
            assert by.setdefault(tuple(h[i:i + k].tolist()), g) == g
        assert len(set(grams.tolist())) == len(by)
    values = rng.integers(0, 9, 300)
    got = common.sliding_argmin(values, 7)
    assert all(values[g] == values[i:i + 7].min() and i <= g < i + 7 for i, g in enumerate(got))


def test_repeats_in_documents(spark):
    docs = source(spark, "documents", "doc_id", "text")
    want = brute.repeats(docs)
    assert sum(w[1] for w in want.values()) > 0
    assert removed(spark, docs) == want


def test_repeats_with_branches(spark):
    rng = random.Random(5)
    word = lambda n=300: f"v{rng.randrange(n)}"
    passages = [[word() for _ in range(m)] for m in (50, 60, 75, 120, 49)]
    few = [word(3) for _ in range(90)]
    docs = []
    for d in range(60):
        text = [word() for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice([*passages, few])
            cut = rng.randrange(0, 12)
            text += p[cut:] + [word() for _ in range(rng.randrange(0, 3))]
        docs.append((d * 3 % 61, " ".join(text)))
    docs += [(100, docs[5][1]), (101, docs[5][1] + " tail"), (102, " ".join(few * 3)), (103, "x " * 200), (104, " x" * 120)]
    assert removed(spark, docs) == brute.repeats(docs)


def test_repeats_odd_rows(spark):
    long = " ".join(f"a{i}" for i in range(70))
    assert substring_dedup.remove_repeats(table(spark, [])).count() == 0
    rows = substring_dedup.remove_repeats(table(spark, [
        (None, long), (4, long), (4, long), (4, long + " b"), (9, long), (11, None), (12, "")])).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in rows) == [
        ("11", 0, 0), ("12", 0, 0), ("4", 70, 0), ("4", 70, 0), ("4", 71, 0), ("9", 70, 70), ("None", 70, 0)]


def test_repeated_rows_are_judged_like_one(spark):
    """Rows repeated anywhere, the later document's too, and a very long text."""
    rng = random.Random(8)
    long = " ".join(f"a{i}" for i in range(300))
    docs = [(1, long), (2, long), (3, "x " + long), (4, " ".join(f"b{rng.randrange(9)}" for _ in range(200)))]
    docs += [(5, " ".join(f"c{i}" for i in range(60_000)) + " " + long), (6, " ".join(f"c{i}" for i in range(100, 50_000, 1)))]
    for d in range(7, 20):
        cut = rng.randrange(200)
        docs.append((d, f"d{d} " + " ".join(f"a{i}" for i in range(cut, cut + 90)) + f" e{d}"))
    want = brute.repeats(docs)
    for again in ([docs[1]], [docs[0], docs[1], docs[1], docs[9], docs[12], docs[4]], docs):
        rows = substring_dedup.remove_repeats(table(spark, docs + again)).collect()
        assert len(rows) == len(docs) + len(again)
        assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows} == {(d, *w) for d, w in want.items()}


@pytest.mark.parametrize("extra", [[], [(900, "One, two THREE"), (901, "das"), (902, None), (903, "...")]])
def test_contamination(spark, extra):
    docs = source(spark, "documents", "doc_id", "text")
    items = source(spark, "benchmark", "item_id", "text") + extra
    docs += [(5000, None), (5001, ""), (5002, "one two. three"), (5003, items[0][1]), (5004, items[1][1].upper() + " é")]
    got = decontamination.hits(table(spark, docs), table(spark, items, "item_id long, text string")).drop("text_key")
    want = brute.contamination(docs, items)
    assert sum(w[5] for w in want) > 3
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_contamination_odd_rows(spark):
    item = " ".join(f"q{i}" for i in range(20))
    items = table(spark, [(1, item), (1, item), (2, item), (None, item)], "item_id long, text string")
    docs = table(spark, [(None, item), (3, item), (3, item), (3, "clean")])
    rows = decontamination.hits(docs, items).collect()
    assert sorted((str(r.doc_id), r.n_hit, r.n_items, r.contaminated) for r in rows) == [
        ("3", 0, 0, False), ("3", 20, 2, True), ("3", 20, 2, True), ("None", 20, 2, True)]
    assert decontamination.clean_documents(docs, items).count() == 1
    empty = table(spark, [], "item_id long, text string")
    assert [r.n_items for r in decontamination.hits(docs, empty).collect()] == [0] * 4
    assert decontamination.hits(table(spark, []), items).count() == 0
