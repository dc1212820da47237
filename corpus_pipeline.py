"""Corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Stages are written as Parquet and read again in between;
all but the last return the columns of documents. Columns that documents doesn't have are left out, whatever their names, so
none can clash with what a stage uses inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metasift.llm import decontaminate, mixing, queries, simhash
from metasift.llm.common import fresh_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Probability from which a predicted language counts.
SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with a probability of at least one half, and writes it to ``lang``.

    Null texts, texts without a letter, and all where no label is known have no language and go. Repeated rows stay.
    Very long texts are read whole. Languages that tie go by code point order. An empty table gives an empty one.
    """
    told = queries.identify(docs.select(COLUMNS), keep=tuple(COLUMNS[1:])).where((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    return told.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, the one with the smallest id; rows are told apart by a key of their own, not by their id.

    Null ids come last; equal ids go by the key. Null and empty texts are near-duplicates of each other. Very long texts are
    read whole. An empty table gives an empty one.
    """
    path = fresh_path(spark, "keyed")
    docs.select(*COLUMNS, F.monotonically_increasing_id().alias("key")).write.parquet(path)
    keyed = spark.read.parquet(path)
    return keyed.join(simhash.first_rows(keyed, "key"), "key", "left_semi").select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item, exact or with few edits, wherever it stands in them.

    Null and empty texts hold none and stay, as do repeated rows. Very long texts are searched whole. Items that tie for a
    place are all found, which changes nothing here. Without items every document stays.
    """
    found = decontaminate.find_leaks(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one where a source's share ends counts as a whole.

    Documents without words are never taken. Rows that repeat an id are all taken as often as the one taken most. A null
    source is a source like any other. Very long texts are counted whole. An empty table gives an empty one.
    """
    taken = mixing.mix(docs, F.array("source")).where("taken > 0").select("doc_id", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("times"))
    # repeated ids were taken each; one row for each id and number is enough to repeat its documents
    times = taken.groupBy("doc_id").agg(F.max("times").alias("times"))
    docs = docs.select(COLUMNS)
    joined = docs.join(times, docs["doc_id"].eqNullSafe(times["doc_id"])).select(*[docs[c] for c in COLUMNS], "times")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row of ``docs`` from the files written: doc_id, start, n_tokens, ids_crc32.

    Null ids come first and equal ids keep any order; null and empty texts are the end id alone; very long texts are one
    document each. An empty table gives an empty one.
    """
    return queries.encode_documents(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_files", token_files),
]

#: Hashes, models and tokenizers aren't within SQL's reach; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
