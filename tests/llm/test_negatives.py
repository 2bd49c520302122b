"""Hard negatives against brute force in whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemill.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50, shift=7, labels=10):
    known = {}
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (label, [float(np.float32(x)) for x in v])
        known[vec_id] = min(known.get(vec_id, own), own)
    known = {i: ((lab + 1) % labels if i % shift == 0 else lab, [math.floor(256 * x) for x in v]) for i, (lab, v) in known.items()}
    out = []
    for a, (label, v) in known.items():
        if a % every:
            continue
        score = {i: min(max(sum(x * y for x, y in zip(v, w)), negatives.LEAST), negatives.MOST) for i, (_, w) in known.items() if i != a}
        first = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in first if known[i][0] == label][:5]:
            inside = [i for i in first if known[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(inside[:3])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def clustered(n, dims, seed, labels=10):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, dims))
    which = rng.integers(0, 12, n)
    x = centres[which] + rng.normal(0, 0.4, (n, dims))
    lab = np.where(rng.random(n) < 0.35, 0, rng.integers(0, labels, n))
    return [(i, x[i].tolist(), int(lab[i])) for i in range(n)]


@pytest.mark.parametrize("dims,seed", [(3, 1), (16, 2)])
def test_against_brute_force(spark, dims, seed):
    rows = clustered(700, dims, seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(negatives.hard_negatives(df, every=10, sizes=negatives.Sizes(block=64))) == brute(rows, every=10)


def test_ties_odd_rows_and_clashing_columns(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), i % 3) for i in range(300)]
    rows += [(300, None, 1), (350, [1.0, None, 0.0, 0.0], 1), (400, [float("nan"), 0.0, 0.0, 0.0], 2), (450, [1.0, 0.0, 0.0, 0.0], None), (None, [1.0, 0.0, 0.0, 1.0], 1),
             (500, [float("inf"), 0.0, 0.0, 0.0], 1), (550, [0.0, 0.0, 0.0, 0.0], 1), (600, [], 2), (650, [2.0, 1.0], 1), (651, [2.0, 1.0, 1.0, 1.0, 7.0], 2)]
    rows += [(50, [2.0, 2.0, 2.0, 2.0], 0)] * 40 + [(49, [2.0, 2.0, 2.0, 1.0], 1)] * 40 + [(-50, [1.0, 2.0, 0.0, 1.0], 0), (-7, [1.0, 2.0, 0.0, 1.0], 9)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("x"), "rank": F.lit(1), "block": F.lit(2)})
    want = brute(rows)
    assert want and got(negatives.hard_negatives(df, sizes=negatives.Sizes(block=50))) == want
    assert got(negatives.hard_negatives(df.limit(0))) == []
    assert got(negatives.hard_negatives(df.where("vec_id = 50"))) == []


def test_scores_beyond_doubles_and_longs(spark):
    rng = np.random.default_rng(4)
    scale = np.array([1.0, 1e5, 3e6, 1e12, 1e30])
    rows = [(i, (rng.normal(0, 1, 3) * scale[i % 5]).tolist(), i % 4) for i in range(150)]
    assert got(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=5, sizes=negatives.Sizes(block=40))) == brute(rows, every=5)


def test_many_sets_maps_and_reads(spark):
    sizes = negatives.Sizes(block=64, zone=16, anchors=4, maps=3, reads=2)
    rows = clustered(900, 6, 5)
    assert got(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=10, sizes=negatives.Sizes(block=64))) == brute(rows, every=10)


def test_places_walk_from_cell_to_neighbour():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[range(1 << bits)] * dims), -1).reshape(-1, dims)
        place = negatives.hilbert_places(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(6)
    a, b = np.floor(rng.normal(0, 100, (20, 9))), np.floor(rng.normal(0, 100, (200, 9)))
    least, greatest = negatives.bounds(a, b.min(axis=0)[None], b.max(axis=0)[None])
    s = negatives.scores(a, b)
    assert (least[:, 0] <= s.min(axis=1)).all() and (greatest[:, 0] >= s.max(axis=1)).all()
