import random

import pytest

from metasift.operators import history
from metasift.streaming import index

EVENT = "slug string, seq long, ts timestamp, included_ids array<string>"


def made(n, seed=0):
    import datetime as dt

    draw = random.Random(seed)
    order = draw.sample(range(10 * n), n)
    return [(draw.choice(["hot", "hot", f"s{draw.randint(0, 20)}", None]), k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k), draw.choice([None, [], [f"r{k}"]])) for k in order]


def shown(df):
    return sorted(map(str, df.select("slug", "n_runs", "last_ts", "last_included", "first_seq").collect()))


@pytest.mark.parametrize("cuts", [[], [1], [40, 41, 90]])
def test_any_split_equals_a_rebuild(spark, tmp_path, cuts):
    """Events in any order and split; a batch written again, as after a failure, changes nothing."""
    rows, source, kept = made(120, 3), str(tmp_path / "in"), str(tmp_path / "index")
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[a:b], EVENT).coalesce(1).write.mode("append").parquet(source)
        index.keep_index(spark.readStream.schema(EVENT).parquet(source), kept, str(tmp_path / "progress")).awaitTermination(60)
        assert shown(index.read_index(spark, kept)) == shown(history.recall(spark.createDataFrame(rows[:b], EVENT)))
    last = len(cuts)
    index.part(spark.createDataFrame(rows[([0, *cuts])[-1] :], EVENT)).write.mode("overwrite").parquet(f"{kept}/batch={last}")
    assert shown(index.read_index(spark, kept)) == shown(history.recall(spark.createDataFrame(rows, EVENT)))


def test_nothing_yet(spark, tmp_path):
    assert index.read_index(spark, str(tmp_path / "none")).collect() == []
