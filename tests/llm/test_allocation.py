"""Mixing, sharding and token files against plain versions and their laws."""

from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
import zlib
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortspan.llm import mixing, sharding, token_files
from cohortspan.llm.common import repeated

DOC = "doc_id long, text string, source string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def documents(spark, folder=brute.FOLDER):
    return spark.read.parquet(f"{folder}/documents.parquet")


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check_mix(rows, docs):
    sizes, source_of, taken, largest = Counter(), {}, Counter(), Counter()
    for d, t, s in docs:
        sizes[s] += len(brute.words(t))
        source_of[d] = s
        largest[s] = max(largest[s], len(brute.words(t)))
    want = plain_targets(sizes)
    for r in rows:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    assert sum(taken.values()) <= 1.5 * sum(sizes.values()) + 1e-6
    slack = sum(largest.values()) / max(1, 1.5 * sum(sizes.values()))
    for s in sizes:
        assert want[s] - largest[s] - 1e-6 <= taken[s] <= want[s] * (1 + slack) + largest[s], s
    return taken


@pytest.mark.parametrize("cuts,tail", [(4096, 100_000), (4, 10)])
def test_mix_documents(spark, monkeypatch, cuts, tail):
    monkeypatch.setattr(mixing, "CUTS", cuts)
    monkeypatch.setattr(mixing, "TAIL_ROWS", tail)
    docs = documents(spark)
    rows = mixing.mix(docs).collect()
    check_mix(rows, [tuple(r) for r in docs.select("doc_id", "text", "source").collect()])
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_cut_is_the_exact_start_of_the_order(spark):
    docs = documents(spark)
    rows = mixing.mix(docs).collect()
    budget = 1.5 * sum(r.size for r in rows)
    total = sum(r.taken for r in rows)
    assert budget - max(r.size for r in rows) <= total <= budget


def test_mix_odd_rows(spark):
    docs = [(1, "a b c", None), (2, None, "x"), (3, "", "x"), (None, "d e", "y"), (5, "f " * 900, "é"), (5, "f " * 900, "é"),
            (7, "g", "y"), (8, "h", "")]
    frame = spark.createDataFrame(docs, DOC).selectExpr("*", "1 AS size", "'k' AS key", "2 AS target")
    rows = mixing.mix(frame).collect()
    assert len(rows) == len(docs) and all(r.taken <= 2 * r.size for r in rows)
    assert {r.doc_id: r.taken for r in rows}[2] == 0
    assert mixing.mix(frame.limit(0)).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(frame.filter("size(split(text, ' ')) < 2 AND text = ''")).collect())
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    assert Counter(r.doc_id for r in mixed.collect())[1] == {r.doc_id: r.taken // max(1, r.size) for r in rows}[1]


def hot_rows(spark, n=6000):
    """A third of the rows under one id, with other texts each; a sixth one and the same row."""
    return spark.range(n).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 6 = 1 THEN 8 ELSE id END AS doc_id",
        "CASE WHEN id % 6 = 1 THEN 'again and again' ELSE concat_ws(' ', transform(sequence(0, id % 15), i -> concat('w', id, i))) END AS text",
        "CASE WHEN id % 6 = 1 THEN 'b' WHEN id % 3 = 0 THEN 'a' ELSE substr('abc', 1 + id % 3, 1) END AS source",
        "CASE WHEN id % 6 = 1 THEN map('k', 1L) ELSE map('k', id) END AS extra")


def test_mix_of_hot_ids_and_hot_rows(spark, monkeypatch):
    docs = hot_rows(spark)
    largest = []
    plain = mixing.running_total

    def watched(df, keys, order, value, out, bits):
        counts = df.groupBy((F.shiftright(F.col(order[0]), 64 - bits))).count().toPandas()["count"]
        largest.append(counts.max() / counts.mean())
        return plain(df, keys, order, value, out, bits)

    monkeypatch.setattr(mixing, "running_total", watched)
    rows = mixing.mix(docs).collect()
    assert largest[0] < 2 and len(rows) == 6000
    budget = 1.5 * sum(r.size for r in rows)
    kept = mixing.mixed_documents(docs).select("doc_id", "text", "extra").collect()
    words = Counter()
    for r in kept:
        words[r.doc_id] += len(r.text.split())
    assert sum(words.values()) == sum(r.taken for r in rows) and budget - 20 <= sum(words.values()) <= budget
    by_id = Counter()
    for r in rows:
        by_id[r.doc_id] += r.taken
    assert +words == +by_id
    most = Counter((r.doc_id, r.text) for r in docs.collect())
    assert all(n <= 2 * most[key] for key, n in Counter((r.doc_id, r.text) for r in kept).items())


def test_repeated_rows_are_dealt_out_in_blocks(spark):
    frame = spark.createDataFrame([(1, 5000), (2, 1), (3, 1024), (4, 1025)], "id long, n long")
    found = defaultdict(list)
    for r in repeated(frame, "n", "at").collect():
        found[r.id].append(r.at)
    assert {k: sorted(v) for k, v in found.items()} == {k: list(range(n)) for k, n in ((1, 5000), (2, 1), (3, 1024), (4, 1025))}


def test_shards_of_hot_ids_and_hot_rows(spark):
    docs = hot_rows(spark)
    check_shards(sharding.shards(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def check_shards(rows, docs, n=8):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(n)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(docs)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (str(d), len((t or "").encode()) + 1, brute.crc(t)) for d, t in docs)


def test_shards_keep_copies_together(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark, "/root/testdata/sf0.01").collect()]
    rows = sharding.shards(documents(spark, "/root/testdata/sf0.01")).collect()
    check_shards(rows, docs)
    text, where = dict(docs), defaultdict(set)
    for r in rows:
        where[text[r.doc_id]].add(r.shard)
    groups = Counter(t for _, t in docs)
    assert sum(len(where[t]) > 1 for t, n in groups.items() if n > 1) == 0


def test_shards_split_a_group_over_quota(spark):
    docs = [(i, "same") for i in range(300)] + [(1000 + i, f"t{i // 2}") for i in range(300)] + [(2000 + i, f"u{i}") for i in range(303)]
    rows = sharding.shards(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check_shards(rows, docs)
    assert len({r.shard for r in rows if r.doc_id < 1000}) <= 5
    again = sharding.shards(spark.createDataFrame(docs[::-1], "doc_id long, text string")).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def shards_of(rows):
    where = defaultdict(set)
    for r in rows:
        where[r.text_crc32].add(r.shard)
    return where


@pytest.mark.parametrize("lone", [0, 400])
def test_shards_keep_pairs_together_without_unlinked_rows(spark, lone):
    docs = [(i, f"p{i // 2}") for i in range(4000)] + [(9000 + i, f"u{i}") for i in range(lone)]
    rows = sharding.shards(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check_shards(rows, docs)
    assert sum(len(s) > 1 for s in shards_of(rows).values()) == 0


@pytest.mark.parametrize("lone", [0, 240])
def test_shards_cut_giant_groups_least(spark, lone):
    docs = [(i, f"g{i % 3}") for i in range(2400 - lone)] + [(9000 + i, f"u{i}") for i in range(lone)]
    rows = sharding.shards(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check_shards(rows, docs)
    giants = [len(s) for s in shards_of(rows).values() if len(s) > 1]
    assert sorted(giants) == ([3, 3, 4] if lone == 0 else [3, 3, 3])


def test_shards_place_rows_of_one_id_and_mixed_groups(spark):
    docs = [(1, "same id")] * 90 + [(100 + i, f"a{i // 60}") for i in range(480)] + [(1000 + i, f"b{i // 38}") for i in range(228)]
    rows = sharding.shards(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check_shards(rows, docs)
    again = sharding.shards(spark.createDataFrame(docs[::-1], "doc_id long, text string")).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert sum(len(s) > 1 for s in shards_of(rows).values()) <= 2


def test_pack_places_every_group_once_within_room():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = Counter(int(n) for n in rng.geometric(rng.choice([0.5, 0.05, 0.002]), rng.integers(1, 60)))
        total = sum(n * c for n, c in sizes.items())
        room = sharding.quotas(total + int(rng.integers(0, 5)), int(rng.integers(1, 9)))
        plan, cuts = sharding.pack(sizes, room)
        used, seen = Counter(), Counter()
        for n, first, last, shard, pieces in plan:
            seen.update((n, at) for at in range(first, last + 1))
            if pieces is None:
                used[shard] += n * (last - first + 1)
            else:
                ends = [0, *[end for end, _ in pieces]]
                assert first == last and ends == sorted(set(ends)) and ends[-1] == n
                used.update({s: b - a for (b, s), a in zip(pieces, ends)})
        assert all(used[s] <= r for s, r in enumerate(room)) and cuts < max(2, len(room))
        assert seen == Counter({(n, at): 1 for n, c in sizes.items() for at in range(1, c + 1)})


def test_shards_odd_rows(spark):
    docs = [(None, "a"), (None, "a"), (3, None), (4, ""), (4, ""), (5, "é")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS n", "3 AS h")
    check_shards(sharding.shards(frame).collect(), docs)
    assert sharding.shards(frame.limit(0)).count() == 0


def round_trip(spark, docs, folder):
    token_files.write_tokens(docs, folder, TOKENIZER)
    return token_files.read_tokens(spark, folder)


def test_tokens_equal_the_tokenizer(spark, tmp_path):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = {r.doc_id: r for r in round_trip(spark, docs, str(tmp_path / "t")).collect()}
    tokenizer = Tokenizer.from_file(TOKENIZER)
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        row = got[r.doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_odd_words_encode_as_whole_texts():
    tokenizer, encode = Tokenizer.from_file(TOKENIZER), token_files.Encoder(TOKENIZER, keep=50)
    for text in ("", " ", "<|endoftext|> a<|startoftext|>b", "ÀÉ İstanbul ſ ŉ ǅ", "é ́x a b c　d", "it's 'S we''re''",
                 "12a3½²", "\x00\x1c\x1f\x85 x", "日本語 テスト 👍🏽", "ΣΑΣ ß ẞ ª º µ × ÷", "a_b-c...!?", "﻿x ‍ ​", "ﬁ Å Ω K"):
        ids = np.frombuffer(encode(text.encode()), encode.dtype).tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_tokens_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(7, "b", 1), (None, "n", 2), (3, None, 3), (7, "a", 4), (-2, "", 5), (3, "c " * 40_000, 6)],
                                 "doc_id long, text string, part int")
    rows = round_trip(spark, docs, str(tmp_path / "a")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, -2, 3, 3, 7, 7] and [r.n_tokens for r in rows] == [2, 1, 1, 40_001, 2, 2]
    assert [r.start for r in rows] == [0, 2, 3, 4, 40_005, 40_007]
    assert round_trip(spark, docs.limit(0), str(tmp_path / "b")).count() == 0
