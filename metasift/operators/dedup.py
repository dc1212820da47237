"""Record deduplication: first record of a key stays, takes over what its duplicates know, and keeps a unique id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasift.functions import text as T
from metasift.operators.ordered import settled, summed_before


def keyed(records: DataFrame) -> DataFrame:
    """``key`` of each record, and ``blank_key`` where a title left nothing to compare (all such records fall together)."""
    key = T.dedup_key(F.col("doi"), F.col("title"))
    return records.withColumn("key", key).withColumn("blank_key", F.col("key") == "title:")


def merged_extra(rows: DataFrame) -> DataFrame:
    """key, extra: for each entry the first value in order that isn't empty."""
    entries = rows.select("key", "seq", F.explode("extra").alias("name", "value")).where(F.length("value") > 0)
    first = entries.groupBy("key", "name").agg(F.min_by("value", "seq").alias("value"))
    return first.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("extra"))


def first_rows(records: DataFrame, key_col: str = "key", seq_col: str = "seq") -> DataFrame:
    """The first row of each key. An aggregate, so hot keys are reduced before the shuffle."""
    others = [c for c in records.columns if c not in (key_col, seq_col)]
    return records.groupBy(key_col).agg(F.min_by(F.struct(*others), seq_col).alias("first"), F.min(seq_col).alias(seq_col)).select(key_col, seq_col, "first.*")


def renamed_ids(kept: DataFrame) -> DataFrame:
    """Kept records with ``new_id``: the first of an id keeps it, the n-th becomes ``id#n``, or the next number no other record has.

    The copy with k records of its id before it gets the k-th number from 2 that no other id holds as its suffix. With those numbers
    sorted, the r-th of them, t, comes before it if t - r is k at most, so it gets k + 1 and as many more as come before: a count of
    earlier rows over ranges, in which only ids and places stand. No id's records meet in one task. ``seq`` tells records apart.
    """
    one = F.lit(1).cast("long")
    ids = kept.select("record_id", "seq")
    later = settled(summed_before(ids, ["record_id"], ["seq"], one, "place").where("place > 0"))
    # a number with a leading zero, or longer than any count, is never given away
    suffix = r"(?s)^(.*)#([1-9][0-9]{0,17})$"
    held = ids.select(F.regexp_extract("record_id", suffix, 1).alias("stem"), F.regexp_extract("record_id", suffix, 2).try_cast("long").alias("number")).where("number > 1").distinct()
    held = held.join(later.select(F.col("record_id").alias("stem")).distinct(), "stem", "left_semi")
    ranked = summed_before(held, ["stem"], ["number"], one, "r").select(F.col("stem").alias("record_id"), F.lit(None).cast(ids.schema["seq"].dataType).alias("seq"), (F.col("number") - F.col("r") - 1).alias("place"), F.lit(0).alias("turn"))
    both = ranked.unionByName(later.withColumn("turn", F.lit(1)))
    numbered = summed_before(both, ["record_id"], ["place", "turn"], F.lit(1) - F.col("turn"), "passed").where("turn = 1")
    given = numbered.select(F.col("seq").alias("own_seq"), F.concat_ws("#", "record_id", F.col("place") + 1 + F.col("passed")).alias("given_"))
    return kept.join(given, F.col("seq") == F.col("own_seq"), "left").withColumn("new_id", F.coalesce("given_", "record_id")).drop("own_seq", "given_")


def deduplicate(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unique records (``record_id`` renamed, ``extra`` merged), duplicates (seq, record_id, source_db, kept_record_id, key), renames (seq, from_id, to_id)."""
    rows = keyed(records)
    kept = settled(first_rows(rows.drop("blank_key", "extra")))
    named = renamed_ids(kept)
    extra = merged_extra(rows)
    unique = named.join(extra, "key", "left")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    unique = unique.withColumn("extra", F.coalesce("extra", empty))
    owners = named.select("key", F.col("seq").alias("kept_seq"), F.col("new_id").alias("kept_record_id"))
    duplicates = rows.join(owners, "key").where("seq <> kept_seq").select("seq", "record_id", "source_db", "kept_record_id", "key")
    renames = named.where("new_id <> record_id").select("seq", F.col("record_id").alias("from_id"), F.col("new_id").alias("to_id"))
    return unique.drop("record_id").withColumnRenamed("new_id", "record_id"), duplicates, renames


def dedup_counts(records: DataFrame) -> DataFrame:
    """n_in, n_out, n_discarded, n_blank: whole-table counts."""
    per_key = keyed(records).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_in"),
        F.count(F.lit(1)).alias("n_out"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_discarded"),
        F.coalesce(F.sum(F.when(F.col("key") == "title:", F.col("n"))), F.lit(0)).alias("n_blank"),
    )
