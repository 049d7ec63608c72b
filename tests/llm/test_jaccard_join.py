"""Documents linked by their word n-grams against a comparison of all sets."""

import random
from collections import defaultdict

import numpy as np
import pytest
from brute import FOLDER, fold, words

from cohortspan.llm import jaccard_join as J


def shingles(text):
    w = words(fold(text))
    return frozenset(" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain(docs):
    sets = [shingles(t) for _, t in docs]
    held = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            held[g].append(i)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        both = defaultdict(int)
        for g in s:
            for j in held[g]:
                both[j] += 1
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[find(j)] = find(i)
    firsts = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            firsts[find(i)] = min(firsts.get(find(i), d), d)
    return [(d, len(s), firsts.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def check(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS h", "3 AS sid", "4 AS doc", "5 AS key")
    got = J.similar_sets(frame)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain(docs), key=key)


def text(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, source, n):
    out = list(source)
    for _ in range(n):
        at = rng.randrange(len(out))
        if rng.random() < 0.5:
            out[at] = f"x{rng.randrange(9999)}"
        else:
            del out[at]
    return out


def test_documents(spark):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_copies_around_the_limit(spark, seed):
    """Families of copies at similarities on both sides of 0.8, chains of them, and a passage that many texts share."""
    rng = random.Random(seed)
    passage, docs = text(rng, 40), []
    for _ in range(25):
        base = text(rng, rng.choice([6, 12, 60, 60, 200]))
        for _ in range(rng.randrange(1, 9)):
            docs.append(edited(rng, base, rng.randrange(0, 1 + len(base) // 25)))
            if rng.random() < 0.4:
                base = docs[-1]
    docs += [text(rng, rng.randrange(1, 12)) + passage + text(rng, rng.randrange(1, 12)) for _ in range(60)]
    rng.shuffle(docs)
    check(spark, [(i, rng.choice([" ", "\n"]).join(d).upper() if i % 5 == 0 else " ".join(d)) for i, d in enumerate(docs)])


def test_one_large_family(spark):
    """A third of all rows are near copies of one text, and another third exact copies."""
    rng = random.Random(5)
    base = text(rng, 80)
    docs = [" ".join(edited(rng, base, rng.randrange(0, 3))) for _ in range(200)] + [" ".join(base)] * 200
    docs += [" ".join(text(rng, 30)) for _ in range(200)]
    check(spark, list(enumerate(docs)))


@pytest.mark.parametrize("block", [J.BLOCK_GRAMS, 2_000])
def test_crowd_of_texts_that_hardly_link(spark, monkeypatch, block):
    """Near copies of one text, most of them too far from each other to link: their pairs do not become rows."""
    monkeypatch.setattr(J, "BLOCK_GRAMS", block)
    rng = random.Random(8)
    base = text(rng, 90)
    docs = [" ".join(edited(rng, base, rng.randrange(1, 5))) for _ in range(300)] + [" ".join(edited(rng, base, 1) + text(rng, 5)) for _ in range(60)]
    docs += [" ".join(text(rng, 30)) for _ in range(50)]
    most, met = [], J._met

    def counted(rows):
        found = met(rows)
        most.append((found.count(), rows.count()))
        return found

    monkeypatch.setattr(J, "_met", counted)
    crowds, apart = [], J._in_crowds
    monkeypatch.setattr(J, "_in_crowds", lambda *parts: crowds.append(1) or apart(*parts))
    check(spark, list(enumerate(docs)))
    assert crowds and all(pairs <= J.CROWD * rows for pairs, rows in most)


def test_sets_of_a_crowd_meet_once(spark, monkeypatch):
    """Near copies that share dozens of crowded n-grams: their links are found at one of these, not at each."""
    rng = random.Random(10)
    base = text(rng, 200)
    docs = [" ".join(edited(rng, base, rng.randrange(1, 8))) for _ in range(250)]
    docs += [" ".join(text(rng, 30)) for _ in range(50)]
    seen, apart = [], J._in_crowds

    def counted(held, *parts):
        found = J.checkpointed(apart(held, *parts))
        seen.append((held.select("h").distinct().count(), held.select("sid").distinct().count(), found.count()))
        return found

    monkeypatch.setattr(J, "CROWD", 5)
    monkeypatch.setattr(J, "_in_crowds", counted)
    check(spark, list(enumerate(docs)))
    assert seen and all(grams > 5 and links < 3 * sets for grams, sets, links in seen), seen


def test_rounds_end_when_n_grams_stay_shared(spark, monkeypatch):
    """Many sets drop out of the first round, but those left share their n-grams among themselves: no second round."""
    rng = random.Random(11)
    docs = []
    for _ in range(40):
        base = text(rng, 60, 50_000)
        docs += [" ".join(base), " ".join(edited(rng, base, 1))]
        shared = text(rng, 45, 50_000)
        docs += [" ".join(shared + text(rng, 30, 50_000)) for _ in range(2)]
    rounds, enough = [], J._enough
    monkeypatch.setattr(J, "_enough", lambda *parts: rounds.append(enough(*parts)) or rounds[-1])
    check(spark, list(enumerate(docs)))
    assert [r.count() for r in rounds] == [80]


def test_n_grams_of_one_set_are_not_written(spark, monkeypatch):
    """Texts of which half is copied: past the first look, written tables hold at most the n-grams that several sets have."""
    rng = random.Random(9)
    docs = []
    for _ in range(60):
        half = text(rng, 60, 50_000)
        docs += [" ".join(half + text(rng, 60, 50_000)) for _ in range(2)] + [" ".join(edited(rng, half, 1)) for _ in range(2)]
    held = defaultdict(int)
    for d in docs:
        for g in shingles(d):
            held[g] += 1
    written, write = [], J.checkpointed

    def kept(df):
        out = write(df)
        for column in {"grams", "at"} & set(out.columns):
            if out.schema[column].dataType.typeName() == "array":
                written.append(out.selectExpr(f"sum(size({column}))").first()[0] or 0)
        return out

    monkeypatch.setattr(J, "checkpointed", kept)
    check(spark, list(enumerate(docs)))
    assert written[0] and max(written) <= sum(n for n in held.values() if n > 1)


def test_lines_of_boilerplate(spark):
    """Texts put together from few frequent lines: hardly any n-gram is rare."""
    rng = random.Random(6)
    lines = [" ".join(text(rng, 9)) for _ in range(12)]
    check(spark, [(i, "\n".join(rng.choices(lines, k=rng.randrange(1, 9)))) for i in range(300)])


def test_odd_rows(spark):
    five = "a b c d e"
    check(spark, [(1, None), (2, ""), (3, " \t"), (4, "A b"), (5, "a B"), (6, five), (7, five + " f"), (None, five), (None, None), (8, "é"), (8, "é"),
                  (9, "a b c d"), (6, five), (6, "z " * 60_000 + five), (10, "z " * 50_000 + five), (11, "q"), (None, "only here known to none")])
    assert J.similar_sets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    check(spark, [(1, None), (2, "one of its own kind that stays alone")])


def test_sets_are_of_distinct_n_grams():
    rng = random.Random(7)
    lists = [[w.encode() for w in text(rng, n, 4)] for n in (0, 1, 4, 5, 6, 300, 0)]
    for got, w in zip(J.shingle_sets(lists, 5), lists, strict=True):
        assert len(got) == len(shingles(b" ".join(w).decode())) and (np.diff(got.astype(object)) > 0).all()
