import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metasift.llm import negatives
from metasift.llm.queries import op12_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, key string, id string, slot string, score string, vector string"


def brute(rows, positives=5, best=10):
    """Rows (id, vector, label), with the contract's labels and bounds."""
    usable = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        usable.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, v, label in usable:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, own) for i, w, own in usable if i != a and len(w) == len(v)]
        for score, p, own in sorted(s for s in scored if s[2] == label)[:positives]:
            within = sorted((s, i) for s, i, o in scored if o != label and 30 * -score <= 100 * -s <= 90 * -score)
            out += [(a, p, rank, n, -score, -s) for rank, (s, n) in enumerate(within[:best], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "k", "i", "s", "c", "v") for i, v, label in rows], SCHEMA).repartition(3)
    found = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, negatives.contract_label(), **options)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in found.collect())


def made(n, seed=0, size=16, spread=0.25):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, spread) for _ in range(size)], draw.randint(0, 3)) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_like_brute_force(spark, seed):
    rows = made(700, seed)
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, anchor_chunk=2) == brute(rows)


def test_ties_and_repeats(spark):
    """Few different vectors, so most scores tie; nearly all of one label."""
    draw = random.Random(1)
    kinds = [[draw.choice([-0.5, 0.25, 0.5]) for _ in range(4)] for _ in range(6)]
    rows = [(i, draw.choice(kinds), 0 if draw.random() < 0.8 else 3) for i in range(900)]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    """Nulls, other lengths, infinities, zeros, large and empty vectors; nothing but what can be compared takes part."""
    rows = made(300, 4) + made(60, 5, size=3)
    rows = [(i if k < 300 else 1000 + i, v, label) for k, (i, v, label) in enumerate(rows)]
    rows += [(None, [0.1] * 16, 1), (2001, None, 1), (2002, [], 1), (2003, [float("nan")] * 16, 1), (2004, [float("inf")] + [0.1] * 15, 2), (2005, [None] + [0.1] * 15, 2), (2006, [0.0] * 16, 2), (2007, [50.0] * 16, 1), (2100, [-60.0] * 16, None), (2200, [40.0] * 16, 2)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, [*rows, (2008, [1e30] * 16, 1)]) == brute(rows)


def test_repeated_anchor(spark):
    rows = made(120, 6)
    assert mined(spark, [*rows, rows[0]]) == sorted(brute(rows) + [r for r in brute(rows) if r[0] == 0])


def test_empty_and_alone(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0, 2.0], 1)]) == []
    assert mined(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)]) == []


@pytest.mark.parametrize("seed", range(4))
def test_survivors_are_those_within(seed):
    """However the planes drop pairs, what is left is what a plain product finds."""
    draw = np.random.default_rng(seed)
    for size, top in ((8, 3), (64, 200), (5, 1 << 20)):
        a, c = draw.integers(-top, top, (20, size)).astype(np.int32), draw.integers(-top, top, (70, size)).astype(np.int32)
        block = negatives.Anchors(np.arange(20), np.arange(20), np.zeros(20), a)
        exact = a.astype(np.int64) @ c.T.astype(np.int64)
        allowed = draw.random((20, 70)) < draw.choice([0.02, 0.5, 1.0])
        least, most = np.sort(draw.choice(exact.ravel(), (2, 20)), axis=0)
        got = {(i, j): s for i, j, s in zip(*(x.tolist() for x in block.survivors(c, allowed, least, most)))}
        want = {(i, j): int(exact[i, j]) for i, j in zip(*np.nonzero(allowed & (exact >= least[:, None]) & (exact <= most[:, None])))}
        assert got == want


def test_query_like_sql(same_as_sql):
    same_as_sql(op12_hard_negatives, negatives.NEGATIVES_SQL)
