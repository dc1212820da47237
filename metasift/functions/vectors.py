"""Hashed bag-of-words vectors and cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSION = 512
TOKEN = "([a-záéíóúñü0-9]+)"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def bucket(token: Column) -> Column:
    """md5 modulo 512: its last nine bits."""
    return F.conv(F.substring(F.md5(token), 30, 3), 16, 10).cast("int") % DIMENSION


def with_vector(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` and a column ``name``: the buckets of each text in order, and their weights, of length one. It's built inside the row, so nothing is shuffled."""
    i = F.sequence(F.lit(0), F.size("sorted_") - 1)
    starts = F.filter(i, lambda k: (k == 0) | (F.get("sorted_", k) != F.get("sorted_", k - 1)))
    runs = lambda: F.transform("starts_", lambda at, k: F.coalesce(F.get("starts_", k + 1), F.size("sorted_")) - at)
    norm = F.sqrt(F.aggregate("counts_", F.lit(0).cast("long"), lambda s, n: s + n.cast("long") * n))
    out = df.withColumn("sorted_", F.sort_array(F.coalesce(F.transform(tokens(F.col(text_col)), bucket), F.array().cast("array<int>"))))
    out = out.withColumn("starts_", F.when(F.size("sorted_") > 0, starts).otherwise(F.array().cast("array<int>"))).withColumn("counts_", runs()).withColumn("norm_", norm)
    # the length stands in an array: as a column of its own it would be put into the lambda and summed up for every bucket
    weights = F.zip_with("counts_", F.array_repeat("norm_", F.size("counts_")), lambda n, norm: n / norm)
    vector = F.struct(F.array_distinct("sorted_").alias("buckets"), weights.alias("weights"))
    return out.withColumn(name, vector).drop("sorted_", "starts_", "counts_", "norm_")


def hash_embed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sparse vectors (id, bucket, weight), of length one, of each row; a text without tokens has no rows."""
    built = with_vector(df.select(F.col(id_col), F.col(text_col).alias("text_")), "text_", "vector_")
    return built.select(id_col, F.inline(F.arrays_zip(F.col("vector_.buckets").alias("bucket"), F.col("vector_.weights").alias("weight"))))


def sparse_dot(a: Column, b: Column) -> Column:
    """Similarity of two vectors of with_vector; 0 where one is missing or nothing is shared.

    The entries of both are sorted together: a bucket that both have stands twice in a row, since each has it once.
    """
    entries = lambda v: F.arrays_zip(v["buckets"].alias("bucket"), v["weights"].alias("weight"))
    merged = F.sort_array(F.concat(entries(a), entries(b)))
    products = F.zip_with(merged, F.slice(merged, 2, 2 * DIMENSION), lambda x, y: F.when(x["bucket"] == y["bucket"], x["weight"] * y["weight"]))
    return F.coalesce(F.aggregate(products, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero; vectors of different lengths are an error."""
    same = F.when(F.size(a) != F.size(b), F.raise_error("vectors of different lengths"))
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(same.cast("double"), F.try_divide(dot(a, b), length), F.lit(0.0))
