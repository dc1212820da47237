"""Frozen inputs: several tables committed as one, read again in place of being made again, and fingerprints of files.

A commit writes its tables to a folder of its own, then one row that names it, counts its rows and sums up their hashes.
The row is written last, by a job with a single file, so readers see all of a commit or none of it; what an attempt that was
stopped left behind is never looked at.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MARKER = "attempt string, tables array<struct<name:string,schema:string,rows:long,digest:string>>"
#: Search tables, in the order they're written.
SEARCH_TABLES = ("records", "log", "failures")


class FrozenError(ValueError):
    """What was frozen isn't what it was."""


def digest(df: DataFrame) -> tuple[int, str]:
    """Number of rows and a sum of their hashes, whatever their order; columns count by place, nulls as such."""
    plain = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    found = df.select(F.xxhash64(plain).cast("decimal(20,0)").alias("h")).agg(F.count("h").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("s")).first()
    return found["n"], found["s"]


def committed(spark: SparkSession, folder: str) -> dict | None:
    """The commit's row, or None where nothing was committed."""
    try:
        rows = spark.read.schema(MARKER).json(f"{folder}/committed").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows[0].asDict(recursive=True) if rows and rows[0]["attempt"] else None


def commit(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> None:
    """Writes ``tables`` and then the row that makes them count. A folder is committed to once; a second commit fails."""
    attempt = f"attempt-{uuid.uuid4().hex}"
    marks = []
    for name, df in tables.items():
        _write(df, f"{folder}/{attempt}/{name}")
        # read back, so that the digest is that of what was written
        rows, hashes = digest(spark.read.schema(df.schema).parquet(f"{folder}/{attempt}/{name}"))
        marks.append((name, df.schema.json(), rows, hashes))
    _write_marker(spark.createDataFrame([(attempt, marks)], MARKER), f"{folder}/committed")


def _write(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def _write_marker(row: DataFrame, path: str) -> None:
    # an attempt that was stopped here may have left an empty folder, which holds no commit
    row.coalesce(1).write.mode("append").json(path)


def thaw(spark: SparkSession, folder: str, check: bool = True) -> dict[str, DataFrame]:
    """The tables of the commit; FrozenError where there's none, or where a table isn't the one that was committed."""
    row = committed(spark, folder)
    if row is None:
        raise FrozenError(f"{folder}: nothing was committed")
    out = {}
    for mark in row["tables"]:
        df = spark.read.schema(StructType.fromJson(json.loads(mark["schema"]))).parquet(f"{folder}/{row['attempt']}/{mark['name']}")
        if check:
            try:
                found = digest(df)
            except Exception as error:
                raise FrozenError(f"{folder}: {mark['name']} can't be read") from error
            if found != (mark["rows"], mark["digest"]):
                raise FrozenError(f"{folder}: {mark['name']} has {found[0]} rows and was committed with {mark['rows']}, or its rows were changed")
        out[mark["name"]] = df
    return out


def memoised(spark: SparkSession, folder: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables of the folder's commit; where there's none ``make`` is called and what it gives is committed first."""
    if committed(spark, folder) is None:
        commit(spark, folder, make())
    return thaw(spark, folder)


def search_tables(found: DataFrame, asked: DataFrame) -> dict[str, DataFrame]:
    """records, log and failures of a search. ``found``: records with ``backend``; ``asked``: backend, query, status (ok or error), error.

    The log has a row for each backend asked, with what it gave; failures are its rows that aren't ok.
    """
    counts = found.groupBy(F.col("backend").alias("of")).agg(F.count(F.lit(1)).alias("n_returned"))
    log = asked.join(counts, F.col("backend") == F.col("of"), "left").select("backend", "query", F.sha2("query", 256).alias("query_sha256"), "status", "error", F.coalesce("n_returned", F.lit(0)).alias("n_returned"))
    return {"records": found, "log": log, "failures": log.where("status <> 'ok'").select("backend", "error")}


def fingerprints(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path (within the folder) and sha256 of each file, line ends taken as one kind. Files below subfolders count too.

    Bytes are never decoded as text: each stands for one character while line ends are replaced. Spark's file sources pass
    over files without a byte, so an empty one is like none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    unified = F.encode(F.replace(F.decode("content", "ISO-8859-1"), F.lit("\r\n"), F.lit("\n")), "ISO-8859-1")
    # the folder may be given without its scheme, so paths are cut behind its last name
    inside = F.regexp_extract("path", f"/{re.escape(folder.rstrip('/').rpartition('/')[2])}/(.*)$", 1)
    return files.select(inside.alias("path"), F.sha2(unified, 256).alias("sha256"))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """path and change (added, removed, changed) between two tables of fingerprints."""
    b, n = (df.select(F.col("path"), F.col("sha256").alias(name)) for df, name in ((before, "was"), (now, "is")))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return b.join(n, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")


def ensure_snapshot(spark: SparkSession, folder: str, now: DataFrame, shown: int = 10) -> DataFrame:
    """The frozen fingerprints: ``now`` is committed the first time; afterwards anything that differs from them is an error, which names some of it."""
    frozen = memoised(spark, folder, lambda: {"fingerprints": now})["fingerprints"]
    differing = changes(frozen, now).orderBy("path").limit(shown + 1).collect()
    if differing:
        names = ", ".join(f"{r['path']} ({r['change']})" for r in differing[:shown])
        raise FrozenError(f"inputs differ from those frozen: {names}{' and more' if len(differing) > shown else ''}")
    return frozen
