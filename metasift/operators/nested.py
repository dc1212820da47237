"""Nested values: as rows of paths, compared field by field, and as canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metasift.operators.ordered import settled

#: Numbers are equal within these, the first relative to the larger one.
RELATIVE, ABSOLUTE = 1e-9, 1e-12


def _kind(value: Column) -> Column:
    """object, array, int, float, string, bool or null of a VARIANT.

    JSON's whole numbers are BIGINT, or DECIMAL without places beyond 18 digits; a decimal shorter than that was written with
    a point, even where its places are zero.
    """
    name = F.schema_of_variant(value)
    digits = F.regexp_extract(name, r"^DECIMAL\((\d+),0\)", 1)
    return (
        F.when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "bool")
        .when(name == "VOID", "null")
        .when((name == "BIGINT") | ((digits != "") & (digits.try_cast("int") > 18)), "int")
        .when(name.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float")
        .otherwise(F.lower(name))
    )


def _step(key: Column, pos: Column) -> Column:
    """A path's next part: ``.name``, ``["any other name"]`` or ``[place]``."""
    quoted = F.concat(F.lit('["'), F.regexp_replace(key, r'(["\\])', r"\\$1"), F.lit('"]'))
    return F.when(key.isNull(), F.concat(F.lit("["), pos.cast("string"), F.lit("]"))).when(key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), key)).otherwise(quoted)


def paths(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """A row for each value within the VARIANT ``value_col``, the value itself among them, whose path is empty.

    id, path, above (the paths that lead there), name (its key, null in an array), kind, size (of arrays), number (of ints and floats), content (JSON of what isn't an
    object or array). Containers are opened a level at a time until none is left, all rows of a level at once. A null value has no rows.
    """
    level = df.select(F.col(id_col).alias("id"), F.lit("").alias("path"), F.array().cast("array<string>").alias("above"), F.lit(None).cast("string").alias("name"), F.col(value_col).alias("value")).where("value IS NOT NULL")
    spark, found = df.sparkSession, None
    while True:
        level = settled(level.withColumn("kind", _kind(F.col("value"))))
        inner = F.col("kind").isin("object", "array")
        size = F.when(F.col("kind") == "array", F.size(F.try_variant_get("value", "$", "array<variant>")))
        number = F.when(F.col("kind").isin("int", "float"), F.try_variant_get("value", "$", "double"))
        rows = level.select("id", "path", "above", "name", "kind", size.alias("size"), number.alias("number"), F.when(~inner, F.to_json("value")).alias("content"))
        found = rows if found is None else found.unionAll(rows)
        opened = level.where(inner)
        if opened.isEmpty():
            return found
        opened = opened.select("id", F.col("path").alias("up"), F.concat("above", F.array("path")).alias("above"), F.col("value").alias("outer"))
        level = opened.lateralJoin(spark.tvf.variant_explode(F.col("outer").outer())).select("id", F.concat("up", _step(F.col("key"), F.col("pos"))).alias("path"), "above", F.col("key").alias("name"), "value")


def differences(actual: DataFrame, expected: DataFrame, id_col: str, value_col: str, *, ignored: tuple[str, ...] = (), relative: float = RELATIVE, absolute: float = ABSOLUTE) -> DataFrame:
    """id, path, problem, expected, actual: where two nested values (VARIANT) of an id differ, at the highest place that does.

    Problems: ``missing`` and ``extra`` (on one side alone), ``kind``, ``length`` (of an array, whose elements are then not
    compared), ``value``, ``repeated`` (the id stands more than once on a side, so it isn't compared) and ``absent`` (the id, or
    its value, stands on one side alone). A float is expected within the tolerances and may be given as a whole number; a whole
    number may not be given as a float. An expected key of ``ignored`` may have any value or be missing; one that isn't expected is extra.
    Null ids are never compared. Without a difference an id has no rows.
    """
    actual, expected = (df.select(F.col(id_col).alias("id"), F.col(value_col).alias("value")).where(F.col(id_col).isNotNull()) for df in (actual, expected))
    numbers = [df.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("values")) for df in (actual, expected)]
    a, e = (n.toDF("id", f"{side}_rows", f"{side}_values") for n, side in zip(numbers, "ae", strict=True))
    counted = a.join(e, "id", "full").fillna(0)
    repeated = (F.col("a_rows") > 1) | (F.col("e_rows") > 1)
    lone = (F.col("a_values") == 0) != (F.col("e_values") == 0)
    whole = counted.where(repeated | lone).select("id", F.lit("").alias("path"), F.when(repeated, "repeated").otherwise("absent").alias("problem"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual"))
    both = settled(counted.where(~repeated & ~lone & (F.col("a_values") > 0)).select("id"))

    sides = [paths(df.join(both, "id", "left_semi"), "id", "value") for df in (actual, expected)]
    columns = ("above", "name", "kind", "size", "number", "content")
    a, e = (side.select("id", "path", *(F.col(c).alias(f"{mark}_{c}") for c in columns)) for side, mark in zip(sides, "ae", strict=True))
    met = a.join(e, ["id", "path"], "full")
    there, wanted = F.col("a_kind").isNotNull(), F.col("e_kind").isNotNull()
    # true for an expected key alone, so that an extra one is told
    free = F.coalesce(F.col("e_name").isin(*ignored), F.lit(False)) if ignored else F.lit(False)
    near = F.abs(F.col("a_number") - F.col("e_number")) <= F.greatest(relative * F.greatest(F.abs("a_number"), F.abs("e_number")), F.lit(absolute))
    same_kind = (F.col("a_kind") == F.col("e_kind")) | ((F.col("e_kind") == "float") & (F.col("a_kind") == "int"))
    same = F.when(F.col("e_kind") == "float", near).when(F.col("e_kind") == "array", F.col("a_size") == F.col("e_size")).when(F.col("e_kind") == "object", True).otherwise(F.col("a_content") == F.col("e_content"))
    problem = F.when(free, "ignored").when(~wanted, "extra").when(~there, "missing").when(~same_kind, "kind").when(~same, F.when(F.col("e_kind") == "array", "length").otherwise("value"))
    told = met.select("id", "path", F.coalesce("e_above", "a_above").alias("above"), problem.alias("problem"), F.coalesce("e_content", "e_kind").alias("expected"), F.coalesce("a_content", "a_kind").alias("actual"))
    told = settled(told.where("problem IS NOT NULL"))
    # what lies below a place that differs, or is ignored, is part of that difference
    below = told.select("id", "path", F.explode("above").alias("over")).join(told.select("id", F.col("path").alias("over")), ["id", "over"], "left_semi").select("id", "path").distinct()
    highest = told.join(below, ["id", "path"], "left_anti").where("problem <> 'ignored'")
    return highest.select("id", "path", "problem", "expected", "actual").unionAll(whole).withColumnRenamed("id", id_col)


def _all_finite(value: Column, kind: T.DataType) -> Column | None:
    """Whether no number within is NaN or infinite, from the type alone; None for types that hold no such number."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(True))
    if isinstance(kind, T.ArrayType):
        return None if _all_finite(value, kind.elementType) is None else F.coalesce(F.forall(value, lambda x: _all_finite(x, kind.elementType)), F.lit(True))
    if isinstance(kind, T.MapType):
        return None if _all_finite(value, kind.valueType) is None else F.coalesce(F.forall(F.map_values(value), lambda x: _all_finite(x, kind.valueType)), F.lit(True))
    if isinstance(kind, T.StructType):
        parts = [p for f in kind.fields if (p := _all_finite(value[f.name], f.dataType)) is not None]
        return reduce(lambda a, b: a & b, parts) if parts else None
    return None


def _refused(name: str) -> None:
    raise OverflowError(name)


def canonical(text: str) -> tuple[str | None, str | None]:
    """A JSON text with keys sorted by code point, no spaces and characters as they are, or why there's none."""
    try:
        out = json.dumps(json.loads(text, parse_constant=_refused), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
        out.encode()
    except json.JSONDecodeError:
        return None, "not_json"
    except UnicodeEncodeError:
        return None, "lone_surrogate"
    except RecursionError:
        return None, "too_deep"
    except (OverflowError, ValueError):
        # a name like NaN, a number beyond a double, or one of too many digits
        return None, "not_a_number"
    return out, None


def canonical_json(df: DataFrame, value_col: str, name: str) -> DataFrame:
    """``df`` with ``name``: struct<json, sha256, problem> of a JSON text, or of a struct, map or array column.

    Keys are sorted by code point at every level, there are no spaces, characters stand as they are, numbers are the shortest
    that mean the same double, nulls stay. What can't be canonical has a problem and no JSON: ``not_json``,
    ``not_a_number`` (NaN, infinities), ``lone_surrogate`` or ``too_deep``. A null value has neither. A VARIANT isn't taken: it
    forgets which whole numbers were floats, so give its text. One pass in Arrow batches, nothing is shuffled.
    """
    kind = df.schema[value_col].dataType
    if isinstance(kind, T.VariantType):
        raise TypeError("a VARIANT doesn't keep its numbers as they were written; give the JSON text")
    text, finite = F.col(value_col), None
    if not isinstance(kind, T.StringType):
        text, finite = F.to_json(value_col, {"ignoreNullFields": "false"}), _all_finite(F.col(value_col), kind)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            last = batch.num_columns - 1
            rows = [(None, None) if t is None else canonical(t) for t in batch.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], [*batch.schema.names[:last], "json_", "problem_"])

    schema = T.StructType([*df.schema.fields, T.StructField("json_", T.StringType()), T.StructField("problem_", T.StringType())])
    out = df.withColumn("text_", text).mapInArrow(batches, schema)
    good = F.lit(True) if finite is None else finite
    found = F.struct(F.when(good, F.col("json_")).alias("json"), F.when(good, F.sha2("json_", 256)).alias("sha256"), F.when(~good, "not_a_number").otherwise(F.col("problem_")).alias("problem"))
    return out.withColumn(name, F.when(F.col(value_col).isNotNull(), found)).drop("json_", "problem_")
