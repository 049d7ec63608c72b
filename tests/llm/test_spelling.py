"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import FOLDER, fold

from cohortspan.llm import spelling as S


def edits(a, b):
    """Whether two words differ by exactly one edit, by trying every edit of the longer one."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def plain(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    rows = {}
    for w, n in words.items():
        near = [x for d in (-1, 0, 1) for x in by_length.get(len(w) + d, []) if edits(w, x)]
        best = min(near, key=lambda x: (-words[x], x.encode()), default=None)
        rows[w] = (best if best and words[best] >= 2 * n else None, n, len(near))
    out = []
    for w, (form, n, near) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.append((w, form, root, n, near, words[form] if form else None))
    return sorted(out)


def check(spark, docs, **how):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS word", "2 AS form")
    got = S.variants(frame, **how)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == plain(docs)
    return got


def misspelt(rng, n_words, n_docs):
    """Texts over a few letters, so that many words are near each other, with chains of forms."""
    words = ["".join(rng.choice("abcdeéÉAB") for _ in range(rng.randint(4, 8))) for _ in range(n_words)]
    docs = []
    for d in range(n_docs):
        picked = [words[min(n_words - 1, int(rng.expovariate(6 / n_words)))] for _ in range(120)]
        docs.append((d, rng.choice([" ", "-", "9"]).join(picked)))
    return docs


@pytest.mark.parametrize("block_rows", [S.BLOCK_ROWS, 40])
def test_equal_to_all_comparisons(spark, block_rows):
    docs = misspelt(random.Random(block_rows), 400, 60)
    check(spark, docs, block_rows=block_rows)


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, docs, block_rows=200)


def test_a_deletion_is_near_its_word(spark):
    """Long documents of one word: where the rule deletes a letter, the variant finds the word."""
    word = "retritioning"
    docs = [(d, f"{word} " * 3) for d in range(400)]
    rows = {r["word"]: r for r in check(spark, docs).collect()}
    assert len(rows) > 1
    assert {r["root"] for r in rows.values()} == {word}


def test_anagrams_share_a_block(spark):
    """Words with equal letter counts cannot be cut apart by the tree; they are dealt by hash."""
    rng = random.Random(4)
    words = sorted({"".join(rng.sample("abcdefgh", 8)) for _ in range(300)} | {"abcdefgx", "abcdefghi"})
    check(spark, [(1, " ".join(words * 3))], block_rows=16)


def test_odd_rows(spark):
    check(spark, [(None, "aaaaa aaaaa aaaaa aaaab"), (1, None), (2, ""), (3, "9 9 9"), (None, "aaaab AAAAB"), (4, "x" * 3), (4, "Ünder ünder ünder under"),
                  (5, "aaaaa " * 50_000), (6, "y" * 300_000 + " " + "under " * 9), (6, "ünder " * 3), (6, "ünder " * 3)])
    assert S.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_edit():
    rng = np.random.default_rng(3)
    for n, m in ((5, 5), (5, 6), (6, 5), (5, 7)):
        a = ["".join(rng.choice(list("ab"), n)) for _ in range(3000)]
        b = ["".join(rng.choice(list("ab"), m)) for _ in range(3000)]
        assert S.one_edit(S._codes(a), S._codes(b)).tolist() == [edits(x, y) for x, y in zip(a, b, strict=True)]


def test_letter_counts_bound_edits():
    words = ["under", "ünder", "undér", "unders", "nder"]
    points = S.vectors(words)
    for i in range(1, len(words)):
        if edits(words[0], words[i]):
            assert np.abs(points[0] - points[i]).sum(dtype=int) <= S.reach(len(words[0]), len(words[i]))
