import itertools
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from metasift.llm import mixing
from metasift.llm.queries import mixing_overlap


def test_shares():
    sizes = {"a": 100, "b": 10, "c": 50, None: 40}
    targets = mixing.share_targets(sizes, 300.0)
    # weights by code point, null last: a 5, b 2, c 1, null 5
    assert targets["b"] == 20
    assert targets[None] == 80
    assert sum(targets.values()) == pytest.approx(300)
    assert targets["a"] / targets["c"] == pytest.approx(5)
    assert mixing.share_targets({}, 0.0) == {}
    assert mixing.share_targets({"a": 0, "b": 0}, 0.0) == {"a": 0, "b": 0}


def best_by_trying(patterns, quotas, rounds):
    """Largest flow and its least cost, over all whole-number flows."""
    edges = [(p, s) for p in patterns for s in p]
    best = (0, 0)
    for flows in itertools.product(*[range(min(rounds * patterns[p], quotas[s]) + 1) for p, s in edges]):
        out, into = defaultdict(int), defaultdict(int)
        for (p, s), f in zip(edges, flows):
            out[p] += f
            into[s] += f
        if all(out[p] <= rounds * patterns[p] for p in patterns) and all(into[s] <= quotas[s] for s in quotas):
            cost = sum(sum(k * min(max(out[p] - k * patterns[p], 0), patterns[p]) for k in range(rounds)) for p in patterns)
            best = max(best, (sum(flows), -cost))
    return best


def routed(patterns, quotas, rounds=2):
    """route() by names."""
    names = list(quotas)
    starts = np.cumsum([0, *(len(p) for p in patterns)])
    codes = np.array([names.index(s) for p in patterns for s in p], np.int64)
    taken = mixing.route(starts, codes, np.array(list(patterns.values()), np.int64), np.array(list(quotas.values()), np.int64), rounds)
    return dict(zip(patterns, taken.tolist()))


@pytest.mark.parametrize("seed", range(80))
def test_flow_is_largest_and_cheapest(seed):
    draw = random.Random(seed)
    names = ["a", "b", None]
    shapes = [("a",), ("b",), ("a", "b"), ("b", None), ("a", "b", None)]
    patterns = {p: draw.randint(0, 3) for p in draw.sample(shapes, 3)}
    quotas = {s: draw.randint(0, 4) for s in names}
    taken = routed(patterns, quotas)
    cost = sum(max(taken[p] - n, 0) for p, n in patterns.items())
    assert (sum(taken.values()), -cost) == best_by_trying(patterns, quotas, 2)
    assert all(taken[p] <= 2 * n for p, n in patterns.items())


def least_cut(patterns, quotas, rounds):
    """The largest flow, as the least cut over all sets of sources."""
    names = list(quotas)
    sets = (set(c) for k in range(len(names) + 1) for c in itertools.combinations(names, k))
    return min(sum(quotas[s] for s in t) + rounds * sum(n for p, n in patterns.items() if not set(p) <= t) for t in sets)


@pytest.mark.parametrize("seed", range(30))
def test_flow_is_the_least_cut(seed):
    draw = random.Random(seed)
    names = list("abcdefg")
    patterns = {tuple(sorted(draw.sample(names, draw.randint(1, 4)))): draw.randint(0, 500) for _ in range(draw.randint(1, 60))}
    quotas = {s: draw.randint(0, draw.choice([50, 3000])) for s in names}
    for rounds in (1, 2, 3):
        taken = routed(patterns, quotas, rounds)
        uses = [sum(min(max(taken[p] - k * n, 0), n) for p, n in patterns.items()) for k in range(rounds)]
        # each round adds to the largest flow of the ones before it, which is the cheapest way
        assert list(itertools.accumulate(uses)) == [least_cut(patterns, quotas, k + 1) for k in range(rounds)]


def test_flow_of_many_patterns():
    """A hundred thousand patterns over fifty sources, far below a minute."""
    draw = np.random.default_rng(1)
    lengths = draw.integers(1, 20, 100_000)
    starts = np.concatenate([[0], lengths.cumsum()])
    codes = np.concatenate([draw.choice(50, n, replace=False) for n in lengths])
    sizes = draw.integers(1, 10_000, 100_000)
    quotas = np.full(50, int(1.5 * sizes.sum()) // 50)
    began = time.perf_counter()
    taken = mixing.route(starts, codes, sizes, quotas)
    assert time.perf_counter() - began < 30
    assert taken.sum() == quotas.sum() and (taken <= 2 * sizes).all()


def test_overlapping_sources(spark):
    """Rows in any order give the same, and targets are met over all patterns."""
    draw = random.Random(4)
    names = ["a", "b", "c", None]
    rows = [(i, "w " * draw.randint(1, 30), sorted(draw.sample(names, draw.randint(1, 3)), key=lambda s: (s is None, s or ""))) for i in range(400)] + [(500, "w w", []), (501, "w w", None)]
    schema = "doc_id long, text string, member array<string>"
    answers = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        answers.append(sorted(map(str, mixing.mix(spark.createDataFrame(rows, schema).repartition(3 + seed), F.col("member")).select("doc_id", "size", "source_size", "target", "taken").collect())))
    assert answers[0] == answers[1] == answers[2]
    found = mixing.mix(spark.createDataFrame(rows, schema), F.col("member")).collect()
    assert len(found) == len(rows)
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    assert {r.taken for r in found if r.doc_id >= 500} == {0}
    patterns, quotas = defaultdict(int), {}
    for r in found:
        patterns[tuple(r.sources or ())] += r.size
    by_source = {s: sum(n for p, n in patterns.items() if s in p) for s in names}
    for s, target in mixing.share_targets(by_source, 1.5 * sum(patterns.values())).items():
        quotas[s] = round(target)
    members = {p: n for p, n in patterns.items() if p}
    assert sum(r.taken for r in found) == least_cut(members, quotas, 2)


def test_many_patterns(spark):
    """More patterns than documents of most of them: each has its own share, and the mix meets the sum of the targets."""
    draw = random.Random(8)
    names = [f"s{k:02}" for k in range(30)]
    rows = [(i, "w " * draw.randint(1, 30), draw.sample(names, draw.randint(1, 4))) for i in range(3000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, member array<string>"), F.col("member")).collect()
    assert len(found) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in found)
    assert sum(r.taken for r in found) == pytest.approx(1.5 * sum(r.size for r in found), abs=30)


def test_repeated_ids_at_the_end_of_a_share(spark):
    """An id that a third of all rows have fills the part where its pattern ends."""
    rows = [(7, "w " * (1 + i % 5), "hot") for i in range(900)] + [(i, "w " * 9, "b") for i in range(1000, 1400)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6), F.array("source")).collect()
    hot = [r for r in found if r.sources == ["hot"]]
    assert sum(r.taken for r in hot) == pytest.approx(hot[0].target, abs=1)
    assert all(0 <= r.taken <= 2 * r.size for r in found)


def test_very_long_text(spark):
    rows = [(1, "w " * 2_000_000, "a"), (2, "w", "a")]
    found = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.array("source")).collect()}
    assert found[1].size == 2_000_000
    assert found[1].taken + found[2].taken == pytest.approx(1.5 * 2_000_001, abs=1)


def test_totals_like_sql(same_as_sql):
    same_as_sql(mixing_overlap, mixing.TOTALS_SQL)


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(["w"] * draw.randint(1, 60)), "hot" if i % 3 == 0 else draw.choice(["a", "b", "c", None])) for i in range(600)] + [(7, "again", "a"), (None, "no id here", "b"), (900, None, "c"), (901, "  \n", "c")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_are_met(docs):
    rows, df = docs
    found = mixing.mix(df, F.array("source")).collect()
    assert len(found) == len(rows)
    by_source = defaultdict(list)
    for r in found:
        by_source[r.sources[0]].append(r)
    sizes = {s: sum(r.size for r in rs) for s, rs in by_source.items()}
    targets = mixing.share_targets(sizes, 1.5 * sum(sizes.values()))
    for s, rs in by_source.items():
        assert {(r.source_size, round(r.target, 6)) for r in rs} == {(sizes[s], round(targets[s], 6))}
        assert abs(sum(r.taken for r in rs) - targets[s]) <= 1
        assert all(0 <= r.taken <= 2 * r.size for r in rs)
        # at most one document is taken in part, the others a whole number of times, within one of each other
        whole = {r.taken // r.size for r in rs if r.size and r.taken % r.size == 0}
        assert sum(r.size > 0 and r.taken % r.size > 0 for r in rs) <= 1 and max(whole) - min(whole) <= 1


def test_reruns_agree(docs):
    _, df = docs
    a, b = (sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(d, F.array("source")).collect()) for d in (df, df.repartition(7)))
    assert a == b


def test_no_source_and_smaller_budget(spark):
    df = spark.createDataFrame([(i, "x " * 10, ["a", "b"] if i % 2 else ["a"]) for i in range(40)] + [(99, "y", [])], "doc_id long, text string, s array<string>")
    found = mixing.mix(df, F.col("s"), budget=1.0).collect()
    assert sum(r.taken for r in found) <= 800
    assert next(r.taken for r in found if r.doc_id == 99) == 0


def test_empty_table(docs):
    _, df = docs
    assert mixing.mix(df.where("false"), F.array("source")).collect() == []
    assert [r.taken for r in mixing.mix(df.where("doc_id = 900"), F.array("source")).collect()] == [0]
