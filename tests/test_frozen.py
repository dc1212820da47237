import hashlib
import random

import pytest
from pyspark.sql import functions as F

from metasift.operators import budget
from metasift.sources import frozen

ROWS = [(k, f"b{k % 3}", None if k % 5 else f"t{k}") for k in range(40)]


def tables(spark, shift=0):
    found = spark.createDataFrame([(k + shift, b, t) for k, b, t in ROWS], "id long, backend string, title string")
    asked = spark.createDataFrame([("b0", "q", "ok", None), ("b1", "q", "ok", None), ("b2", "q", "ok", None), ("b3", "q", "error", "down")], "backend string, query string, status string, error string")
    return frozen.search_tables(found, asked)


def shown(found):
    return {name: sorted(map(str, df.collect())) for name, df in found.items()}


@pytest.mark.parametrize("stop", range(5))
def test_stopped_at_every_step(spark, tmp_path, monkeypatch, stop):
    """A run that ends after any table, or before the marker, leaves nothing that counts; the next one gives the whole."""
    folder, steps = str(tmp_path / "run"), []

    def ending(real):
        def write(df, path):
            if len(steps) == stop:
                raise KeyboardInterrupt
            steps.append(path)
            real(df, path)

        return write

    with monkeypatch.context() as patch:
        patch.setattr(frozen, "_write", ending(frozen._write))
        patch.setattr(frozen, "_write_marker", ending(frozen._write_marker))
        if stop < 4:
            with pytest.raises(KeyboardInterrupt):
                frozen.memoised(spark, folder, lambda: tables(spark))
            assert frozen.committed(spark, folder) is None
            with pytest.raises(frozen.FrozenError):
                frozen.thaw(spark, folder)
        else:
            frozen.memoised(spark, folder, lambda: tables(spark))
    first = shown(frozen.memoised(spark, folder, lambda: tables(spark, 0)))
    assert first == shown(tables(spark))
    # what was committed is read again, not searched again
    assert shown(frozen.memoised(spark, folder, lambda: tables(spark, 1000))) == first
    assert len(first["failures"]) == 1 and len(first["log"]) == 4


def test_changed_tables_are_told(spark, tmp_path):
    folder = str(tmp_path / "run")
    frozen.memoised(spark, folder, lambda: tables(spark))
    attempt = frozen.committed(spark, folder)["attempt"]
    path = f"{folder}/{attempt}/records"
    more = spark.read.parquet(path).limit(1).collect()
    spark.createDataFrame(more, spark.read.parquet(path).schema).write.mode("append").parquet(path)
    with pytest.raises(frozen.FrozenError, match="records has 41 rows"):
        frozen.thaw(spark, folder)
    frozen.thaw(spark, folder, check=False)


def test_empty_tables(spark, tmp_path):
    none = {name: df.where("false") for name, df in tables(spark).items()}
    assert shown(frozen.memoised(spark, str(tmp_path / "run"), lambda: none)) == {name: [] for name in frozen.SEARCH_TABLES}


def test_digest_sees_order_of_nothing_but_rows(spark):
    a = spark.createDataFrame(ROWS, "id long, backend string, title string")
    assert frozen.digest(a) == frozen.digest(a.orderBy(F.desc("id")).repartition(3))
    assert frozen.digest(a) != frozen.digest(a.withColumn("title", F.coalesce("title", F.lit(""))))
    assert frozen.digest(a)[0] == 40 and frozen.digest(a.unionAll(a)) != frozen.digest(a)


def test_fingerprints(spark, tmp_path):
    """Both line ends give the same; bytes that aren't text and subfolders count, files without a byte don't."""
    root = tmp_path / "protocol"
    (root / "strings").mkdir(parents=True)
    contents = {"a.yml": b"x\r\ny\n", "strings/b.txt": b"\xff\xfe\r\n\r", "gone.yml": b"z", "odd name.txt": "é".encode()}
    for name, content in contents.items():
        (root / name).write_bytes(content)
    (root / "empty.yml").write_bytes(b"")
    found = {r.path: r.sha256 for r in frozen.fingerprints(spark, str(root)).collect()}
    want = {name: hashlib.sha256(c.replace(b"\r\n", b"\n")).hexdigest() for name, c in contents.items()}
    assert {k.replace("%20", " "): v for k, v in found.items()} == want
    folder = str(tmp_path / "frozen")
    now = lambda: frozen.fingerprints(spark, str(root))
    frozen.ensure_snapshot(spark, folder, now())
    (root / "a.yml").write_bytes(b"x\ny\n")
    frozen.ensure_snapshot(spark, folder, now())
    (root / "a.yml").write_bytes(b"x\ny")
    (root / "new.txt").write_bytes(b"n")
    (root / "gone.yml").unlink()
    with pytest.raises(frozen.FrozenError, match=r"a.yml \(changed\), gone.yml \(removed\), new.txt \(added\)"):
        frozen.ensure_snapshot(spark, folder, now())


def by_loop(needs, total):
    """Everybody in turn, those who need least first."""
    shares, left = {}, total
    order = sorted(range(len(needs)), key=lambda i: (needs[i], i))
    for at, i in enumerate(order):
        shares[i] = min(needs[i], left // (len(order) - at))
        left -= shares[i]
    return shares


@pytest.mark.parametrize("seed", range(6))
def test_fair_shares_like_a_loop(spark, seed):
    draw = random.Random(seed)
    needs = [draw.choice([0, 7, 7, 7, draw.randint(0, 100)]) for _ in range(draw.choice([1, 2, 300]))]
    for total in (0, 1, sum(needs) // 3, sum(needs) // 2 + 1, sum(needs), sum(needs) + 5):
        found = budget.fair_shares(spark.createDataFrame(list(enumerate(needs)), "id long, need long").repartition(4), "id", "need", total).collect()
        assert {r.id: r.share for r in found} == by_loop(needs, total)


def test_fair_shares_odd_rows(spark):
    rows = [(1, None), (2, -5), (3, 4), (3, 4), (None, 9)]
    found = sorted(((r.id or 0, r.need, r.share) for r in budget.fair_shares(spark.createDataFrame(rows, "id long, need long"), "id", "need", 10).collect()))
    assert found == [(0, 9, 4), (1, 0, 0), (2, 0, 0), (3, 4, 3), (3, 4, 3)]
    assert budget.fair_shares(spark.createDataFrame([], "id long, need long"), "id", "need", 10).collect() == []
