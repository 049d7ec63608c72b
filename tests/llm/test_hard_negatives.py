"""Hard negatives against all products."""

import math
import random

import numpy as np
import pytest

from cohortspan.llm import hard_negatives as H


def plain(rows):
    ok = []
    for i, v, label in rows:
        if i is None or label is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(256 * float(x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, q, label in {(i, tuple(q), label) for i, q, label in ok if i % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j, other) for j, p, other in ok if len(p) == len(q))
        for less, j, _ in [s for s in scored if s[2] == label and s[1] != i][:5]:
            found = [s for s in scored if s[2] != label and 80 * -less <= 100 * -s[0] <= 100 * -less][:5]
            out += [(i, j, rank, negative, -less, -worse) for rank, (worse, negative, _) in enumerate(found, 1)]
    return sorted(out)


def check(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
        "*", "1 AS q", "2 AS score", "3 AS rank", "4 AS block", "5 AS cell")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = H.mine(frame)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(rows)
    assert sorted(tuple(r) for r in got.collect()) == want
    return want


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BLOCK_ROWS", 64), ("ANCHOR_ROWS", 3), ("PROBE_ROWS", 40), ("CELL_ROWS", 4), ("SAMPLE_ROWS", 300)):
        monkeypatch.setattr(H, name, value)


def test_embeddings(spark, small):
    read = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    assert check(spark, [tuple(r) for r in read])


@pytest.mark.parametrize("spread", [0.1, 1.5])
def test_clusters_copies_and_ties(spark, small, spread):
    """A third of the rows is one vector, and lengths differ; scores tie."""
    rng = random.Random(int(spread * 10))
    centres = [[rng.gauss(0, 1) for _ in range(7)] for _ in range(6)]
    rows = []
    for i in range(900):
        c = rng.randrange(6)
        v = centres[0] if i % 3 == 0 else [x * rng.choice([1, 1, 4]) + rng.gauss(0, spread) for x in centres[c]]
        rows.append((i, v, rng.choice([c, rng.randrange(10)])))
    assert check(spark, rows + rows[:6] + [(100, rows[5][1], 3)] * 9)


def test_cells_come_in_falling_order_and_hold_their_scores():
    rng = np.random.default_rng(5)
    points = np.floor(rng.normal(0, 60, (400, 9))).astype(np.int64)
    index = H.Index(tuple(H._kmeans(part, 6) for part in (points[:, :4], points[:, 4:])))
    codes = [H.nearest(h, c) for h, c in zip(index.halves(points), index.centres, strict=True)]
    index.radii = tuple(np.array([max([0.0, *np.sqrt(((h[code == c] - centres[c]) ** 2).sum(1))]) for c in range(6)])
                        for h, code, centres in zip(index.halves(points), codes, index.centres, strict=True))
    cell = codes[0] * 6 + codes[1]
    index.rows = np.bincount(cell, minlength=36)
    for anchor in points[:30]:
        seen = list(H.visit(index.bounds(anchor), index.rows))
        assert sorted(c for _, c in seen) == np.flatnonzero(index.rows).tolist()
        assert all(a >= b for (a, _), (b, _) in zip(seen, seen[1:], strict=False))
        for bound, c in seen:
            assert (points[cell == c] @ anchor <= bound).all()


def test_far_cells_are_not_visited(spark):
    """With tight clusters most cells cannot reach an anchor's positives."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (41, 16))
    rows = [(i, (centres[i % 41] + rng.normal(0, 0.01, 16)).tolist(), int(i % 4)) for i in range(4000)]
    eligible = H.eligible(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).cache()
    books, blocks = H.build(eligible, 4000)
    asked = H._anchors(eligible, H.EVERY)
    near = H.positives(asked, blocks, spark.sparkContext.broadcast(books), 5).collect()
    least = {(r["block"], r["row"]): -r["best"][-1]["less"] for r in near}
    index, visited = books[16], []
    for a in asked.collect():
        _, _, matrix = H._arrays(a["ids"], a["labels"], a["matrix"], 16)
        for i, q in enumerate(matrix):
            visited.append(sum(index.rows[c] for bound, c in H.visit(index.bounds(q), index.rows) if bound >= least[a["block"], i]))
    assert len(visited) == 40 and np.mean(visited) < 1200


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    check(spark, [(0, [1.0, 2.0], 1), (100, None, 2), (200, [nan, 1.0], 1), (300, [inf, 1.0], 1), (400, [None, 1.0], 1), (None, [1.0, 1.0], 1),
                  (500, [1.0, 1.0], None), (1, [0.0, 0.0], 1), (2, [-1.0, -2.0], 1), (3, [1.0], 1), (600, [], 3), (601, [], 3), (602, [], 4),
                  (700, [0.0, 0.0], 9), (4, [1.0, 1.5], 5), (4, [1.0, 1.5], 5), (-100, [2.0, 1.0], 1), (5, [0.9, 1.9], 2), (0, [1.0, 2.0], 1),
                  (0, [1.0, 2.0], 7), (6, [3.0, 3.0], 0), (800, [2e6, 1.0], 1), (7, [2e6, 2.0], 1), (9, [1.9e6, 2.0], 2)])
    assert H.mine(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert H.mine(spark.createDataFrame([(100, None, 1)], "vec_id long, embedding array<float>, label int")).count() == 0
