"""Hard negatives against all scores."""

import numpy as np
import pytest

from loomline.llm import hard_negatives
from pyspark.sql import functions as F
from tests.conftest import same


def brute(rows, every=100, scale=256, positives=5, negatives=10, least=30, most=90):
    """rows: (id, label, vector); one row of an id."""
    x = {i: (label, [max(-hard_negatives.HELD, min(hard_negatives.HELD, int(np.floor(float(v) * scale)))) for v in vector]) for i, label, vector in rows}
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    out = []
    for a in (i for i in x if i % every == 0):
        score = {i: dot(x[a][1], v) for i, (_, v) in x.items() if i != a and len(v) == len(x[a][1])}
        best = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in best if x[i][0] == x[a][0]][:positives]:
            hard = [i for i in best if x[i][0] != x[a][0] and least * score[p] <= 100 * score[i] <= most * score[p]][:negatives]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(hard)]
    return sorted(out)


def rows(n=900, d=10):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, d))
    out = []
    for i in range(n):
        v = (centres[i % 6] + 0.4 * rng.normal(size=d)).astype(np.float32)
        if i % 9 == 0:
            v = np.round(v)  # ties
        if i % 50 == 1:
            v = np.zeros(d, np.float32)
        out.append((i, int(rng.integers(4)), v.tolist()))
    return out + [(n + k, 1, [1e30, *[0.5] * (d - 1)]) for k in range(2)] + [(2000 + k, k % 3, [0.1 * k, 1.0]) for k in range(30)] + [(3000, 1, []), (3001, 2, [])]


SCHEMA = "vec_id long, label int, embedding array<float>, asks int, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize(("shard", "block", "codes", "step"), [(16_384, 8192, 16, 1024), (100, 4, 3, 7), (20, 100, 1, 1)])
def test_mine(spark, monkeypatch, shard, block, codes, step):
    for name, v in (("SHARD", shard), ("BLOCK", block), ("STEP", step)):
        monkeypatch.setattr(hard_negatives, name, v)
    monkeypatch.setattr(hard_negatives.MultiIndex.__init__, "__defaults__", (codes,))
    odd = [(None, 1, [1.0] * 10), (5000, None, [1.0] * 10), (5100, 1, None), (5200, 1, [float("nan")] * 10), (5300, 1, [1.0, None] * 5), (5400, 2, [float("inf")] * 10)]
    got = hard_negatives.mine(frame(spark, rows() + odd + rows()[:7]), F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows(), 50)


@pytest.mark.parametrize("seed", range(6))
def test_windows_are_certified(seed):
    """Whatever the order of cells and windows, an index walk gives what a sort of all scores gives; and it leaves cells out."""
    rng = np.random.default_rng(seed)
    x = np.floor(256 * (rng.normal(size=(8, 6))[rng.integers(8, size=3000)] + 0.1 * rng.normal(size=(3000, 6))))
    ids, label = rng.permutation(3000), rng.integers(3, size=3000)
    index = hard_negatives.MultiIndex(x, ids, label)
    for _ in range(20):
        q = x[rng.integers(3000)]
        s = (x @ q).astype(np.int64)
        cut = sorted(rng.choice(s, 4).tolist())
        windows = [(cut[0], cut[1]), (cut[2], cut[3]), (cut[3], cut[0]), (-hard_negatives.ANY, cut[1])]
        got = index.best(q, [(u[0], v[0]) for u, v in index.bounds(q[None, :])], index.label != 1, windows, 5)
        for (lo, hi), (found, score) in zip(windows, got, strict=True):
            at = np.flatnonzero((label != 1) & (s >= lo) & (s <= hi))
            at = at[np.lexsort((ids[at], -s[at]))[:5]]
            assert found.tolist() == ids[at].tolist() and score.tolist() == s[at].tolist()
    assert index.scored < 0.7 * 20 * 3000


def test_window_of():
    for p in (-7, 0, 1, 10, 11, 333):
        lo, hi = hard_negatives.window_of(p, 30, 90)
        assert [s for s in range(-400, 400) if 30 * p <= 100 * s <= 90 * p] == list(range(lo, hi + 1))


def test_one_hot_label_and_equal_rows(spark):
    """A label with most rows, equal vectors in it, and rows that share an id."""
    own = [(i, 0 if i % 3 else 1 + i % 2, [1.0, 0.5 * (i % 4), 0.25]) for i in range(600)]
    got = hard_negatives.mine(frame(spark, own + [(0, 5, [9.0] * 3)] + own[100:200]), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute(own)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(none, F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(frame(spark, [(1, 1, [1.0]), (100, 1, [1.0])]), F.col("vec_id") % 100 == 0).count() == 0


def test_query(spark, sf_dir, duck):
    same(hard_negatives.op13_hard_negatives(spark, sf_dir).toPandas(), duck.execute(hard_negatives.SQL["op13_hard_negatives"]).df())
