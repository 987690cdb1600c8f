"""Nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagefleet.llm import multi_index as M

SCHEMA = "vec_id long, embedding array<double>, label int, v string, id string, cell long, score double"


def brute(rows, k=5):
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    fine = [(i, np.array([*v, *[0.0] * (8 - len(v))])) for i, v in fine]
    fine = [(i, v / np.abs(v).max()) for i, v in fine]
    out = []
    for q, x in fine:
        if q % 50 == 0:
            near = sorted((-round(float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), 12), i) for i, y in fine if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


def vectors(n, seed=1):
    r = np.random.default_rng(seed)
    rows = [(i, r.standard_normal(8).astype(np.float32).tolist()) for i in range(n)]
    rows += [(10_000 + i, rows[50][1]) for i in range(40)] + [(20_000 + i, rows[7][1]) for i in range(200)]
    rows += [(30_000, None), (30_050, []), (30_100, [0.0] * 8), (30_150, [1.0, None] * 4), (30_200, [float("nan")] * 8),
             (30_250, [float("inf")] * 8), (30_300, [1.0, 2.0]), (None, [1.0] * 8), (100, rows[100][1]),
             (30_350, [1e-30] * 8), (30_400, [3e38] * 8), (30_450, [1e300] * 8), (30_500, [1e-310] * 8)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", "id", 1, 0.5) for i, v in rows], SCHEMA).repartition(4)


def test_a_full_walk_is_exact(spark):
    rows = vectors(400)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in M.nearest(frame(spark, rows), F.col("id") % 50 == 0, share=1.0).collect())
    want = brute(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-9)


def test_few_and_no_candidates(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (3, [1.0, 1.0])]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in M.nearest(frame(spark, rows), F.col("id") % 50 == 0).collect())
    assert got == [(0, 1, 3), (0, 2, 50), (50, 1, 3), (50, 2, 0)]
    assert M.nearest(frame(spark, [(0, [1.0])]), F.col("id") % 50 == 0).count() == 0
    assert M.nearest(spark.createDataFrame([], SCHEMA), F.col("id") % 50 == 0).count() == 0


def recall(spark, table, k=5):
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    x = M.unit(np.array([v for _, v in rows]))
    ids = np.array([i for i, _ in rows])
    asked = np.flatnonzero(ids % 50 == 0)
    truth = {}
    for q in asked:
        near = x @ x[q]
        near[q] = -9
        truth[ids[q]] = set(ids[np.argsort(-near, kind="stable")[:k]])
    got: dict = {}
    for r in M.nearest(table, F.col("id") % 50 == 0, k).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(got[q] & t) / k for q, t in truth.items()])


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall(spark, sf):
    assert recall(spark, spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")) >= 0.9


def test_recall_of_many_vectors(spark):
    table = spark.read.parquet("/root/testdata/check_l/embeddings.parquet")
    assert table.count() > 50_000 and recall(spark, table) >= 0.9


def test_streams_carry_the_best(spark, monkeypatch):
    """Many blocks, parts and ties give what one block does."""
    rows = vectors(900, seed=3)
    want = sorted(map(tuple, M.nearest(frame(spark, rows), F.col("id") % 10 == 0, share=0.5).collect()))
    monkeypatch.setattr(M, "BLOCK", 16)
    monkeypatch.setattr(M, "QUERIES", 20)
    monkeypatch.setattr(M, "SPLITS", 3)
    assert sorted(map(tuple, M.nearest(frame(spark, rows), F.col("id") % 10 == 0, share=0.5).collect())) == want


def test_cells_come_by_distance():
    r = np.random.default_rng(2)
    a, b = r.random(6), r.random(7)
    sizes = {c: 1 for c in range(42) if c % 3}
    got = M.cells_by_distance(a, b, sizes, 1000)
    assert sorted(got) == sorted(sizes)
    total = [a[c // 7] + b[c % 7] for c in got]
    assert total == sorted(total)
    assert M.cells_by_distance(a, b, sizes, 5) == got[:5]
