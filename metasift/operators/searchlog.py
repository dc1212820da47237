"""What a search log must hold: one entry a database, import or injected search, sound in itself and true to the records.

Entries have the columns of ENTRY; those that a table lacks are null. A fault has a database (null for the whole log), a level
(FAIL or WARN) and a name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.functions import text as T

ENTRY = {
    "database": "string", "db_key": "string", "kind": "string", "status": "string", "n_returned": "long", "max_results": "long", "error": "string", "source_db": "array<string>",
    "query": "string", "query_sha256": "string", "query_origin": "string", "query_file": "string", "file_sha256": "string",
}
FAULT = "database string, level string, fault string"


def completed(entries: DataFrame) -> DataFrame:
    """Entries with every column of ENTRY."""
    return entries.select(*[(F.col(name) if name in entries.columns else F.lit(None)).cast(kind).alias(name) for name, kind in ENTRY.items()])


def _blank(c: Column) -> Column:
    return F.coalesce(F.length(c) == 0, F.lit(True))


def entry_faults(entries: DataFrame, failures: DataFrame | None = None, strings: DataFrame | None = None) -> DataFrame:
    """Faults of single entries. ``failures`` (database): the recorded failures; ``strings`` (query_file, text): the kept query files."""
    log = completed(entries)
    imported = log.agg(F.coalesce(F.sum(F.when((F.col("kind") == "manual_import") & (F.col("status") == "ok"), F.col("n_returned"))), F.lit(0)).alias("imported"))
    log = log.crossJoin(F.broadcast(imported))
    # without the tables there is nothing to contradict
    log = log.withColumn("recorded", F.lit(True)) if failures is None else log.join(failures.select("database", F.lit(True).alias("recorded")).distinct(), "database", "left")
    log = log.withColumn("kept", F.col("query")) if strings is None else log.join(strings.select("query_file", T.strip(F.col("text")).alias("kept")), "query_file", "left")
    status, kind, origin, failed = F.col("status"), F.col("kind"), F.col("query_origin"), F.col("status") == "failed"
    is_file, has_file, no_query = F.coalesce(origin == "file", F.lit(False)), F.col("query_file").isNotNull(), F.col("query").isNull()
    rules = {
        ("FAIL", "negative count"): F.col("n_returned") < 0,
        ("FAIL", "key of another database"): (kind == "database") & ~F.col("db_key").eqNullSafe(T.database_key(F.col("database"))),
        ("FAIL", "unknown status"): status == "unknown",
        ("WARN", "failed"): failed,
        ("FAIL", "failed without an error or with records"): failed & (_blank(F.col("error")) | (F.coalesce("n_returned", F.lit(0)) != 0) | (F.coalesce(F.size("source_db"), F.lit(0)) > 0)),
        ("FAIL", "failure not recorded"): failed & F.col("recorded").isNull(),
        ("WARN", "manual search without imports"): (status == "manual_only") & (F.col("imported") == 0),
        ("WARN", "manual search without its query"): (status == "manual_only") & no_query,
        ("WARN", "the question served as query"): origin == "question_fallback",
        ("WARN", "as many results as asked for"): (status == "ok") & (F.col("n_returned") == F.col("max_results")),
        ("FAIL", "no query or origin"): (status == "ok") & (((kind == "database") & (no_query | origin.isNull())) | ((kind == "injected") & no_query)),
        ("FAIL", "hash of another query"): ~no_query & ~F.col("query_sha256").eqNullSafe(F.sha2("query", 256)),
        ("FAIL", "origin and file disagree"): is_file != has_file,
        ("FAIL", "file holds another query"): is_file & has_file & ~F.col("kept").eqNullSafe(F.col("query")),
        ("FAIL", "import without a hash"): (kind == "manual_import") & (status == "ok") & _blank(F.col("file_sha256")),
    }
    found = F.array(*[F.when(rule, F.struct(F.lit(level).alias("level"), F.lit(fault).alias("fault"))) for (level, fault), rule in rules.items()])
    return log.select("database", F.explode(F.array_compact(found)).alias("one")).select("database", "one.*")


def log_faults(entries: DataFrame, records: DataFrame, failures: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """Faults of the log as a whole, against the records (source_db), the recorded failures and the declared databases (database)."""
    log = completed(entries)
    whole = lambda rows, level, fault: rows.select(F.lit(None).cast("string").alias("database"), F.lit(level).alias("level"), F.lit(fault).alias("fault"))
    counted = log.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("n_returned"))), F.lit(0)).alias("returned"), F.count_if(F.col("kind") == "injected").alias("injected"), F.count_if(F.col("kind") == "database").alias("searched"))
    one = counted.crossJoin(F.broadcast(records.agg(F.count(F.lit(1)).alias("held"))))
    only_injected = (F.col("injected") > 0) & (F.col("searched") == 0)
    of_log = log.select(F.explode("source_db").alias("source_db")).distinct()
    of_records = records.select("source_db").distinct()
    differ = of_log.exceptAll(of_records).unionAll(of_records.exceptAll(of_log)).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    out = [whole(one.where("n = 0"), "FAIL", "no entry"), whole(one.where("injected > 0"), "WARN", "injected search"), whole(one.where("returned <> held"), "FAIL", "counts and records disagree"), whole(differ, "FAIL", "sources of log and records disagree")]
    if failures is not None:
        orphans = failures.select("database").distinct().join(log.where("status = 'failed'"), "database", "left_anti")
        out.append(orphans.select("database", F.lit("FAIL").alias("level"), F.lit("failure without an entry").alias("fault")))
    if declared is None:
        out.append(whole(one.where(~only_injected), "WARN", "declared databases unknown"))
    else:
        key = T.database_key(F.col("database"))
        missing = declared.select("database", key.alias("key")).distinct().join(log.where("kind = 'database'").select(F.col("db_key").alias("key")), "key", "left_anti")
        missing = missing.crossJoin(F.broadcast(counted)).where(~only_injected)
        out.append(missing.select("database", F.lit("FAIL").alias("level"), F.lit("declared but not searched").alias("fault")))
    return reduce(lambda a, b: a.unionByName(b), out)
