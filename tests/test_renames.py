"""Numbers of repeated ids against a plain loop over the records."""

import random

from metasift.operators import dedup
from metasift.operators.ordered import summed_before
from pyspark.sql import functions as F


def plain(ids: list[str]) -> list[str]:
    """Each later copy takes the least number, from its own place on, that nobody has."""
    names, copies, out = set(ids), {}, []
    for own in ids:
        copies[own] = copies.get(own, 0) + 1
        free = next(n for n in range(copies[own], len(ids) + 3) if n == 1 or f"{own}#{n}" not in names) if copies[own] > 1 else 1
        out.append(own if copies[own] == 1 else f"{own}#{free}")
        names.add(out[-1])
    return out


def renamed(spark, ids):
    rows = spark.createDataFrame(list(enumerate(ids)), "seq long, record_id string")
    return [r.new_id for r in dedup.renamed_ids(rows).orderBy("seq").collect()]


def test_known(spark):
    assert renamed(spark, ["a", "a", "b", "a#2", "a"]) == ["a", "a#3", "b", "a#2", "a#4"]
    assert renamed(spark, ["a", "a", "a#02", "a#1", "a#99999999999999999999"]) == ["a", "a#2", "a#02", "a#1", "a#99999999999999999999"]
    assert renamed(spark, ["a#2", "a#2", "a", "a", "a#2#2"]) == ["a#2", "a#2#3", "a", "a#3", "a#2#2"]
    assert renamed(spark, []) == []


def test_random(spark):
    rng = random.Random(5)
    ids = [rng.choice(["a", "b", "a#2", "a#3", "a#7", "b#2", "a#2#2", "", "#2", "c\nd", "c\nd#2", f"x{rng.randrange(30)}"]) for _ in range(400)]
    assert renamed(spark, ids) == plain(ids)


def test_one_id_fills_the_table(spark):
    rows = spark.range(20_000).select(F.col("id").alias("seq"), F.when(F.col("id") % 4000 == 1, F.concat(F.lit("a#"), F.col("id").cast("string"))).otherwise("a").alias("record_id"))
    ids = [r.record_id for r in rows.orderBy("seq").collect()]
    found = dedup.renamed_ids(rows.repartition(8))
    assert [r.new_id for r in found.orderBy("seq").collect()] == plain_fast(ids)
    assert found.select("new_id").distinct().count() == 20_000


def plain_fast(ids):
    """The same as ``plain`` for one repeated id."""
    held, free, out, seen = set(ids), 2, [], False
    for own in ids:
        if own != "a" or not seen:
            seen = seen or own == "a"
            out.append(own)
            continue
        while f"a#{free}" in held:
            free += 1
        out.append(f"a#{free}")
        free += 1
    return out


def test_sums_before(spark):
    rows = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 7), ("a", 3, 8), ("a", 2, 9)], "g string, o int, v int")
    found = summed_before(rows, ["g"], ["o"], F.col("v"), "s").select("g", "o", "s").collect()
    assert {tuple(r) for r in found} == {(None, 1, 0), (None, 2, 5), ("a", 1, 0), ("a", 2, 7), ("a", 3, 16)}
