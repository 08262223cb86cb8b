"""Nearest neighbours against brute force."""

import numpy as np

from vicinal.llm import nearest as M
from vicinal.llm.nearest import nearest, rounded

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def good(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, is_query, k):
    rows = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and good(v)]
    out = []
    for i in {i for i, _ in rows if is_query(i)}:
        q = min((v.tolist() for j, v in rows if j == i))
        near = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in rows if j != i and len(v) == len(q))
        out += [(i, n + 1, j, s) for n, (s, j) in enumerate(near[:k])]
    return sorted(out)


def check(spark, rows, is_query, k=10):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    got = sorted(tuple(r) for r in nearest(df.where("vec_id % 10 = 0"), df, k).collect())
    want = brute(rows, is_query, k)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12)


def test_clusters_and_ties(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_BYTES", 40 * 24 * 8)
    monkeypatch.setattr(M, "HELD", 7)
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(12, 24))
    v = (centres[rnd.integers(0, 12, 1500)] + rnd.normal(scale=0.02, size=(1500, 24))).astype(np.float32)
    v[300:420] = v[300]
    v[0] = v[300]
    check(spark, [(int(i), x.tolist()) for i, x in enumerate(v)], lambda i: i % 10 == 0)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (10, None), (20, []), (30, [0.0, 0.0]), (40, [nan, 1.0]), (50, [inf, 1.0]), (60, [None, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (70, [1e-30, 1e30]), (80, [1.0, 2.0, 3.0]), (3, [1e-20, -1e-20]), (90, [1.0, 0.0]), (90, [0.5, 0.0])]
    check(spark, rows, lambda i: i % 10 == 0)
    assert nearest(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA)).count() == 0


def test_error_bound():
    rnd = np.random.default_rng(0)
    a, b = rnd.normal(size=(50, 64)) * 10.0 ** rnd.integers(-9, 9, (50, 1)), rnd.normal(size=(60, 64))
    (x, sx, la, _, ea), (y, sy, _, rb, eb) = rounded(a), rounded(b)
    dot = (x @ y.T).astype(float) * sx[:, None] * sy[None, :]
    assert (np.abs(dot - a @ b.T) <= (la[:, None] * eb[None, :] + ea[:, None] * rb[None, :]) * (1 + 1e-9)).all()


def test_components_of_any_size(spark):
    """Squares that overflow or vanish lose no row: distances as exact fractions have them."""
    from fractions import Fraction

    rnd = np.random.default_rng(11)
    rows = [(i, (rnd.normal(size=3) * 10.0 ** rnd.choice([-200, -160, 0, 5, 160, 200])).tolist()) for i in range(60)]
    rows += [(100, [1e200, 0.0, 0.0]), (110, [-1e200, 1e-200, 0.0]), (120, [1e-200, 0.0, 0.0]), (121, [2e-200, 0.0, 0.0]), (130, [5e-324, 0.0, 0.0]), (131, [0.0, 5e-324, 0.0]), (140, [1.5e308, 0.0, 0.0]), (141, [1.4e308, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for part in (df, df.where("vec_id in (120, 121, 130, 131)")):
        ids = {r.vec_id for r in part.select("vec_id").collect()}
        got = nearest(part.where("vec_id % 10 = 0"), part, 3).collect()
        exact = {i: [Fraction(x) for x in v] for i, v in rows if i in ids}
        for q in (i for i in ids if i % 10 == 0):
            near = sorted((sum((a - b) ** 2 for a, b in zip(exact[q], v, strict=True)), i) for i, v in exact.items() if i != q)[:3]
            mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
            assert len(mine) == len(near)
            for (square, _), (_, vid, score) in zip(near, mine, strict=True):  # in double precision some are ties
                own = sum((a - b) ** 2 for a, b in zip(exact[q], exact[vid], strict=True))
                assert abs(own - square) <= square * Fraction(1, 10**12)
                assert Fraction(score) ** 2 == own == 0 or abs(Fraction(score) ** 2 - own) <= own / 10**9 or square < Fraction(5e-324) ** 2 * 100
