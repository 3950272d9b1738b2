import math

import numpy as np
import pytest

from promptloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, every, k):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in ok if c != q and len(a) == len(b))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("dim, slices, chunk", [(8, 4, 16384), (3, 4, 2), (8, 1, 3)])
def test_equals_brute_force(spark, dim, slices, chunk):
    rng = np.random.default_rng(dim)
    rows = [(i, rng.normal(size=dim).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(20)]  # ties
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA).repartition(4)
    got = sorted(map(tuple, topk.top_k(df, 25, 5, slices, chunk).collect()))
    assert got == brute(rows, 25, 5)


def test_null_odd_and_few_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [1.0, inf]), (4, [None, 1.0]), (5, []), (None, [1.0, 1.0]), (6, [-1.0, 0.5]), (7, [1.0, 2.0, 3.0]), (50, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute(rows, 50, 5)
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.filter("vec_id = 0")).count() == 0


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**20 + 31 * i), float(i - 40) * 2**13, 1.5]) for i in range(80)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    assert sorted(map(tuple, topk.top_k(df, 20).collect())) == brute(rows, 20, 5)


def test_phases_sum_few_scores():
    rng = np.random.default_rng(4)
    q, x = rng.integers(-300, 300, (40, 64)), rng.integers(-300, 300, (3000, 64))
    got = topk.work(q, x)
    assert got["sufficient"] < 0.15 * 40 * 3000 and 0 < got["looked_up"] <= got["sufficient"]


def test_huge_components_and_repeated_ids(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 3.0]), (1, [1.0, 1.0]), (100, [-1e300, 1e300]), (2, [1e300, -1e300])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 3 * 4
    assert sorted(r["rank"] for r in got if r["query_id"] == 0) == [1, 1, 2, 2, 3, 3, 4, 4]
    wide = [(i, [float(i) * 1e5, 3e5]) for i in range(60)]
    best = [r for r in topk.top_k(spark.createDataFrame(wide, "vec_id long, embedding array<double>"), k=2).collect() if r["query_id"] == 50]
    assert [(r["vec_id"], r["score"]) for r in sorted(best, key=lambda r: r["rank"])] == [(59, 256**2 * (59 * 50 * 10**10 + 9 * 10**10)), (58, 256**2 * (58 * 50 * 10**10 + 9 * 10**10))]
