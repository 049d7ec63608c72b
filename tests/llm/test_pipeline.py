"""Every stage of the pipeline against a plain version over its own input."""

from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
import zlib
from test_allocation import TOKENIZER, check_mix, plain_targets
from test_simhash import slow_components, slow_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline as P
from cohortspan.llm import simhash, toxicity
from cohortspan.runtime import checkpointed


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{brute.FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(checkpointed(stage(spark, out[-1], brute.FOLDER)))
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_columns_and_shape(kept):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]
    assert all(tuple(k.columns) == P.COLUMNS for k in kept[:5])
    assert [k.count() for k in kept[:4]] == sorted([k.count() for k in kept[:4]], reverse=True)


def test_toxicity(spark, kept):
    marks = toxicity.score(kept[0], spark.read.parquet(f"{brute.FOLDER}/labels.parquet")).collect()
    assert set(texts(kept[1])) == {r.doc_id for r in marks if r.predicted == 0}


def test_near_duplicates(kept):
    before = texts(kept[1])
    ids = sorted(before)
    groups = slow_components([slow_fingerprint(before[i]) for i in ids])
    assert sorted(texts(kept[2])) == [ids[g] for g in sorted(set(groups))]


def test_decontamination(spark, kept):
    items = [tuple(r) for r in spark.read.parquet(f"{brute.FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.contamination(sorted(texts(kept[2]).items()), items)
    assert any(w[5] for w in want)
    assert set(texts(kept[3])) == {w[0] for w in want if not w[5]}


def test_mixing(kept):
    before = {r.doc_id: r for r in kept[3].collect()}
    times = Counter(r.doc_id for r in kept[4].collect())
    row = lambda d: type("Row", (), {
        "doc_id": d, "size": len(brute.words(before[d].text)), "taken": times[d] * len(brute.words(before[d].text))})
    sizes = Counter()
    for d, r in before.items():
        sizes[r.source] += len(brute.words(r.text))
    want = plain_targets(sizes)
    rows = [row(d) for d in before]
    for r in rows:
        r.source_size, r.target = sizes[before[r.doc_id].source], want[before[r.doc_id].source]
    check_mix(rows, [(d, r.text, r.source) for d, r in before.items()])


def test_tokens(kept):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got, start = defaultdict(list), 0
    for r in kept[5].orderBy("start").collect():
        assert r.start == start
        start += r.n_tokens
        got[r.doc_id].append(r.ids_crc32)
    text = texts(kept[0])
    for d, n in Counter(r.doc_id for r in kept[4].collect()).items():
        ids = np.array([*tokenizer.encode(text[d], add_special_tokens=False).ids, 2], "<u4")
        assert got[d] == [zlib.crc32(ids.tobytes())] * n


def test_one_of_each_group_stays_whatever_the_ids(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (7, "x y z w"), (7, "x y z w"), (9, "x y z w"), (None, "x y z w"), (7, "other words here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS root", "2 AS n")
    kept = simhash.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [
        (None, "a b c d e"), (7, "x y z w"), (7, "other words here now")]))


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{brute.FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
