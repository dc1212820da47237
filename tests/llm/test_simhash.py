import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from metasift.llm import graph, simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    pieces = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    counts = [sum(xxhash.xxh64_intdigest(p.encode(), 42) >> b & 1 for p in pieces) for b in range(64)]
    return sum(1 << b for b in range(64) if pieces and 2 * counts[b] > len(pieces))


def brute_components(rows, radius=2):
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= radius and group[i] != group[j]:
                    low, high = sorted((group[i], group[j]))
                    group = [low if g == high else g for g in group]
                    changed = True
    return [(doc, f"{fp:016x}", min(d for (d, _), h in zip(rows, group) if h == g)) for (doc, _), fp, g in zip(rows, fps, group)]


def check(documents, rows, **options):
    found = simhash.near_duplicates(documents(rows), **options)
    assert sorted(map(tuple, found.collect())) == sorted(brute_components(rows))


@pytest.mark.parametrize("tree_size", [2048, 3])
def test_equals_brute_force(documents, prose, tree_size):
    """Also with trees so small that shards are sharded again."""
    texts = prose(30, words=120)
    draw = random.Random(1)
    near = []
    for t in texts[:8]:
        for _ in range(6):
            words = t.split()
            words[draw.randrange(len(words))] = "changed"
            near.append(" ".join(words))
    rows = list(enumerate([*texts, *near, *texts[:5], None, "", "  \t\n", "one", "one two", "ONE two", "É b c"]))
    draw.shuffle(rows)
    check(documents, rows, tree_size=tree_size)


def test_repeated_rows_and_long_text(documents):
    check(documents, [(5, "a b c d"), (5, "a b c d"), (3, "a b c d"), (9, "x y " * 60_000)])


def test_null_id(documents):
    rows = simhash.near_duplicates(documents([(None, "a b c"), (4, "a b c"), (None, "other words here")])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == sorted([(None, 4), (4, 4), (None, None)], key=str)


def test_one_id_with_different_texts_merges_no_groups(documents):
    check(documents, [(7, "a b c d"), (7, "quite other words in here"), (8, "a b c d"), (5, "quite other words in here"), (9, "a b c d")])


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).collect() == []


def test_links_equal_all_pairs():
    """Chains of one-bit steps, and a dense ball: the forest must connect what all pairs connect."""
    draw = random.Random(2)
    centre = draw.getrandbits(64)
    fps = [centre]
    for _ in range(40):
        fps.append(fps[-1] ^ (1 << draw.randrange(64)))
    fps += [centre ^ (1 << draw.randrange(64)) for _ in range(40)] + [draw.getrandbits(64) for _ in range(40)]
    fps = list(dict.fromkeys(fps))

    def classes(links):
        forest = simhash.Forest(len(fps))
        for i, j in links:
            assert (fps[i] ^ fps[j]).bit_count() <= 2
            forest.join(i, j)
        return [forest.root(i) for i in range(len(fps))]

    every = classes((i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2)
    assert classes(simhash.links_within(fps, 2)) == every


@pytest.mark.parametrize("tree_size", [2048, 40, 1])
def test_links_of_crowded_shards(spark, tree_size):
    """Most fingerprints agree in 32 bits and many in 48, so shards are sharded again and again; the classes stay those of all pairs."""
    draw = random.Random(6)
    centre = draw.getrandbits(64)
    fps = {centre ^ draw.getrandbits(draw.choice([12, 16, 32])) for _ in range(300)} | {draw.getrandbits(64) for _ in range(20)}
    for fp in list(fps)[:100]:
        fps.add(fp ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)))
    fps = sorted(fps)
    number = {int(np.uint64(fp).view(np.int64)): i for i, fp in enumerate(fps)}
    found = simhash.fingerprint_links(spark.createDataFrame([(k,) for k in number], "fp long"), tree_size).collect()
    expected, forest = simhash.Forest(len(fps)), simhash.Forest(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                expected.join(i, j)
    for r in found:
        assert (fps[number[r.a]] ^ fps[number[r.b]]).bit_count() <= 2
        forest.join(number[r.a], number[r.b])
    assert [forest.root(i) for i in range(len(fps))] == [expected.root(i) for i in range(len(fps))]


def test_linked_fingerprints_share_a_shard(spark):
    draw = random.Random(4)
    pairs = set()
    for _ in range(60):
        a = draw.getrandbits(64)
        b = a ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64))
        pairs.add(tuple(sorted(int(np.uint64(x).view(np.int64)) for x in (a, b))))
    rows = spark.createDataFrame([(x,) for pair in pairs for x in pair], "fp long").distinct()
    links = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.fingerprint_links(rows).collect()}
    assert links == {p for p in pairs if p[0] != p[1]}


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.range(n - 1).select((F.lit(n - 1) - F.col("id")).alias("a"), (F.lit(n - 2) - F.col("id")).alias("b")).unionAll(spark.range(3).select((F.col("id") + 1000).alias("a"), F.lit(999).cast("long").alias("b")))
    rows = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert rows == {**{i: 0 for i in range(n)}, 999: 999, 1000: 999, 1001: 999, 1002: 999}
