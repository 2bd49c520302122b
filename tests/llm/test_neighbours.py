"""Nearest neighbours: recall against brute force, exact scores, ties, vectors that take no part."""

import pytest
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tablemill.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=5, every=50):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(np.float32(v), dtype=np.float64))
    out = {}
    for i in good:
        if i % every == 0:
            scores = [(-float((good[i] * v).sum() / (math.sqrt((good[i] ** 2).sum()) * math.sqrt((v**2).sum()))), j) for j, v in good.items() if j != i]
            out[i] = sorted(scores)[:k]
    return out


def test_recall_and_scores_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = plain([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = defaultdict(list)
    for r in neighbours.nearest_neighbours(table, list_rows=32).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5] and [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        exact = {j: -s for s, j in want[q]}
        hits += sum(j in exact for _, j, _ in rows)
        assert all(abs(exact[j] - s) < 1e-12 for _, j, s in rows if j in exact)
    assert hits >= 0.9 * 5 * len(want)


def test_copies_ties_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    same, other = rng.normal(size=4).tolist(), rng.normal(size=4).tolist()
    rows = [(i, same) for i in range(0, 400, 10)] + [(i, other) for i in range(1, 30, 7)] + [(1000 + i, rng.normal(size=4).tolist()) for i in range(60)]
    odd = [(50_000, None), (50_050, []), (50_100, [0.0] * 4), (50_150, [1.0, None, 0.0, 0.0]), (50_200, [float("nan")] * 4), (50_250, [float("inf"), 0.0, 0.0, 0.0]), (50_300, [1.0, 2.0]), (None, same), (0, same)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], SCHEMA).withColumn("ids", F.lit("x"))
    want = plain([r for r in rows])
    for block in (4096, 7):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        got = defaultdict(list)
        for r in sorted(neighbours.nearest_neighbours(table, probes=100.0).collect()):
            got[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
        assert got == {q: [(j, round(-s, 9)) for s, j in near] for q, near in want.items()}


def test_ties_of_different_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    ids = rng.permutation(600).tolist()
    v, w = rng.normal(size=4), rng.normal(size=4)
    rows = [(ids[i], (v * 2.0**i).tolist()) for i in range(-20, 40)] + [(ids[40 + i], (w * 2.0 ** (i - 15)).tolist()) for i in range(30)]
    rows += [(ids[100 + 16 * i + j], [float(2**i) if j % 4 == d else 0.0 for d in range(4)]) for i in range(20) for j in range(16)]
    rows = list({i: (i, x) for i, x in rows}.values())
    table = spark.createDataFrame([(i, x, 1) for i, x in rows], SCHEMA).repartition(7)
    want = plain(rows, every=10)
    assert sum(len({s for s, _ in near}) == 1 for near in want.values()) > 20
    for block in (4096, 7):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        got = defaultdict(list)
        for r in sorted(neighbours.nearest_neighbours(table, every=10, probes=100.0).collect()):
            got[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
        assert got == {q: [(j, round(-s, 9)) for s, j in near] for q, near in want.items()}


def test_few_and_none(spark):
    few = spark.createDataFrame([(50, [1.0, 0.0], 1), (3, [0.0, 2.0], 1), (100, [1.0, 1.0], 1)], SCHEMA)
    got = sorted(tuple(r)[:3] for r in neighbours.nearest_neighbours(few).collect())
    assert got == [(50, 1, 100), (50, 2, 3), (100, 1, 3), (100, 2, 50)]
    assert neighbours.nearest_neighbours(few.where("vec_id = 50")).collect() == []
    assert neighbours.nearest_neighbours(few.limit(0)).collect() == []


def test_graph_search_finds_what_a_scan_finds():
    x = neighbours.unit(np.random.default_rng(3).normal(size=(3000, 16)))
    index = neighbours.build_index(x, 100)
    ids, sims = index.search(x[:500], 24)
    assert (ids[:, 0] == neighbours.nearest(x[:500], index.centroids)).mean() > 0.97
    assert (np.diff(sims, axis=1) <= 1e-12).all()
    sizes = np.bincount(neighbours.nearest(x, index.centroids))
    assert sizes.max() <= 3 * 3000 / 100


def test_vectors_of_any_size(spark):
    """Squares that leave the range of doubles: the same neighbours and scores as vectors of common size have."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 6))
    sizes = np.array([2.0**-1020, 2.0**-660, 1.0, 2.0**660, 2.0**1015])[np.arange(120) % 5]
    plain = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    far = spark.createDataFrame([(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(x, sizes))], "vec_id long, embedding array<double>")
    got, want = (sorted(tuple(r) for r in neighbours.nearest_neighbours(df, every=10).collect()) for df in (far, plain))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-12)
    assert all(-1.0000001 <= g[3] <= 1.0000001 for g in got)
