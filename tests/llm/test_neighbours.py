import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metasift.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, query_id long, id string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in vectors], SCHEMA)


def brute(vectors, k, every):
    def good(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)

    kept = [(i, [float(np.float32(x)) for x in v]) for i, v in vectors if i is not None and good(v)]
    out = []
    for q, a in kept:
        if q % every == 0:
            near = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))), i) for i, b in kept if i != q and len(a) == len(b))[:k]
            out += [(q, n, i, d) for n, (d, i) in enumerate(near, 1)]
    return sorted(out)


def found(spark, vectors, k=10, every=100, chunk=2048):
    rows = neighbours.nearest(table(spark, vectors), F.col("vec_id") % every == 0, k=k, query_chunk=chunk).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows)


def same(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert [x[3] for x in a] == pytest.approx([x[3] for x in b], rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("chunk", [2048, 7])
def test_equals_brute_force(spark, chunk):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(8, 12))
    vectors = [(i, (centres[i % 8] + draw.normal(scale=10.0 ** -(i % 5), size=12)).tolist()) for i in range(700)]
    same(found(spark, vectors, every=20, chunk=chunk), brute(vectors, 10, 20))


def test_hot_vector_and_ties(spark):
    vectors = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(i, [1.0, 2.0, 3.0 + i * 1e-4]) for i in range(400, 420)]
    same(found(spark, vectors), brute(vectors, 10, 100))


def test_odd_vectors(spark):
    vectors = [(0, [1.0, 0.0]), (100, None), (200, [0.0, 0.0]), (300, [float("nan"), 1.0]), (400, [None, 1.0]), (500, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [1e-30, 0.0]), (2, [1e30, -1e30]), (3, [1.0, 2.0, 3.0]), (600, [1.0, 2.0, 4.0]), (700, [])]
    same(found(spark, vectors), brute(vectors, 10, 100))


def test_empty_and_few(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0, 1.0])]) == []


def test_squares_beyond_double_precision(spark):
    vectors = [(0, [1e160, 1.0]), (1, [1.0, 2.0]), (2, [-1e160, 0.0]), (3, [1e160, 5.0])]
    rows = neighbours.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 3, 4.0), (2, 1, float("inf")), (3, 2, float("inf"))]


def test_bounds_hold():
    draw = np.random.default_rng(5)
    a, b = (neighbours.Rounded(np.arange(50), draw.normal(size=(50, 16)) * 10.0 ** draw.integers(-3, 4, size=(50, 1))) for _ in range(2))
    lower, upper = a.bounds(b)
    exact = np.linalg.norm(a.vectors[:, None] - b.vectors[None], axis=2)
    assert (lower <= exact).all() and (exact <= upper).all()


def test_on_the_tables(same_as_sql):
    from metasift.llm import queries

    same_as_sql(queries.op8_neighbours, queries.oracle_sql()["op8_neighbours"])
