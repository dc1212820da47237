"""Tables for other tools: pivots in first-seen order and text renderings of rows."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.functions import text as T

#: Fixed vocabulary of the risk-of-bias exchange format.
JUDGMENTS = {"low": "Low", "some_concerns": "Some concerns", "high": "High", "unclear": "No information"}
NO_INFORMATION = "No information"
#: More columns than a pivot should have.
MOST_COLUMNS = 1000


def first_seen(rows: DataFrame, col: str, seq_col: str = "seq") -> list[str]:
    """Distinct values by their first place; a pivot's columns, so few."""
    found = rows.groupBy(col).agg(F.min(seq_col).alias("first")).orderBy("first", col).limit(MOST_COLUMNS + 1).collect()
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"{col} has more than {MOST_COLUMNS} values")
    return [r[0] for r in found]


def pivot(rows: DataFrame, row_col: str, col_col: str, cell: Column, missing: str, seq_col: str = "seq", columns: list[str] | None = None) -> DataFrame:
    """One row for each ``row_col``, one column for each value of ``col_col`` in first-seen order."""
    names = columns or first_seen(rows, col_col, seq_col)
    wide = rows.withColumn("cell", cell).groupBy(row_col).pivot(col_col, names).agg(F.max_by("cell", seq_col))
    return wide.fillna(missing, names)


def judgment(value: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in JUDGMENTS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, value), F.lit(NO_INFORMATION))


def robvis(domains: DataFrame, overall: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Study, a column for each domain, Overall. ``domains``: study_id, domain, judgment, seq; ``overall``: study_id, overall."""
    wide = pivot(domains, "study_id", "domain", judgment(F.col("judgment")), NO_INFORMATION, columns=columns)
    whole = overall.select("study_id", judgment(F.coalesce("overall", F.lit("unclear"))).alias("Overall"))
    return whole.join(wide, "study_id", "left").select(F.col("study_id").alias("Study"), *[F.coalesce(c, F.lit(NO_INFORMATION)).alias(c) for c in wide.columns[1:]], "Overall")


def extraction_table(fields: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each study: values, a dash where there is none, a mark where a value needs review."""
    value = F.coalesce(T.empty_to_null(F.col("value")), F.lit("—"))
    cell = F.when(F.col("status") == "needs_review", F.concat(value, F.lit(" ⚠️"))).otherwise(value)
    return pivot(fields, "study_id", "key", cell, "—", columns=columns)


def bibtex(records: DataFrame) -> DataFrame:
    """record_id, entry: an article if the year is known, else a miscellany."""
    escape = lambda c: F.regexp_replace(c, "[{}]", "")
    kind = F.when(F.col("year").isNotNull(), "article").otherwise("misc")
    line = lambda name, value: F.concat(F.lit(f"  {name} = {{"), value, F.lit("}"))
    lines = F.array_compact(F.array(line("title", escape(F.col("title"))), F.when(F.size("authors") > 0, line("author", escape(F.array_join("authors", " and ")))), F.when(F.col("year").isNotNull(), line("year", F.col("year").cast("string"))), F.when(F.col("doi").isNotNull(), line("doi", F.col("doi"))), F.when(F.col("url").isNotNull(), line("url", F.col("url")))))
    return records.select("record_id", F.concat(F.lit("@"), kind, F.lit("{"), T.cite_key(F.col("record_id")), F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}\n")).alias("entry"))


def adherence(items: DataFrame, judgments: DataFrame) -> DataFrame:
    """Every checklist item with its status; unjudged ones are ``sin_evaluar``."""
    return items.join(judgments.select("item", "status", "evidence"), "item", "left").withColumn("status", F.coalesce("status", F.lit("sin_evaluar")))


def csv_text(rows: DataFrame, most: int = 100_000) -> str:
    """A small table as CSV text on the driver; numbers as Python writes them with six digits."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows; write the table with Spark instead")
    buffer = io.StringIO()
    writer = csv.writer(buffer, lineterminator="\n")
    writer.writerow(rows.columns)
    writer.writerows([f"{v:.6g}" if isinstance(v, float) else v for v in row] for row in found)
    return buffer.getvalue()
