"""Articles in XML files: files of any size are split at the articles' ends, and what doesn't parse is kept apart.

Each article is parsed for itself, so one that isn't well formed costs no other; Spark's reader of whole XML files gives up
the rest of a file there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = (
    "MedlineCitation struct<PMID:struct<_VALUE:string>, Article:struct<ArticleTitle:string, Abstract:struct<AbstractText:array<struct<_VALUE:string>>>,"
    " AuthorList:struct<Author:array<struct<ForeName:string,LastName:string>>>, Journal:struct<JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,"
    " ELocationID:array<struct<_EIdType:string,_VALUE:string>>>>, PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"
)
CORRUPT = "_corrupt_record"
START, END = "<PubmedArticle", "</PubmedArticle>"


def read_articles(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Articles, in the columns that records.pubmed() takes, and what began like one but isn't well formed: path, text.

    ``seq`` is the file's path and the article's place among those read, so it orders articles but doesn't count them. A
    file that ends within an article has one that isn't well formed. Files without articles, and empty ones, have no rows.
    """
    pieces = spark.read.option("lineSep", END).text(folder).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("place"), "value")
    # what stands before the first tag, or behind the last article, is the file's frame
    at = F.regexp_instr("value", F.lit(START + r"[\s>]"))
    whole = pieces.where(at > 0).select("path", "place", F.concat(F.substring(F.col("value"), at, F.length("value")), F.lit(END)).alias("xml"))
    parsed = whole.withColumn("of", F.from_xml("xml", F.lit(f"{ARTICLE}, {CORRUPT} string"), {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}))
    bad = F.col("of").isNull() | F.col(f"of.{CORRUPT}").isNotNull()
    cite, article = "of.MedlineCitation", "of.MedlineCitation.Article"
    good = parsed.where(~bad).select(
        F.struct("path", "place").alias("seq"),
        F.col(f"{cite}.PMID._VALUE").alias("PMID"),
        F.col(f"{article}.ArticleTitle").alias("ArticleTitle"),
        F.struct(F.transform(f"{article}.Abstract.AbstractText", lambda t: t["_VALUE"]).alias("AbstractText")).alias("Abstract"),
        F.col(f"{article}.AuthorList").alias("AuthorList"),
        F.col(f"{article}.Journal.JournalIssue.PubDate").alias("PubDate"),
        F.col("of.PubmedData.ArticleIdList").alias("ArticleIdList"),
        F.col(f"{article}.ELocationID").alias("ELocationID"),
    )
    return good, parsed.where(bad).select("path", F.col("xml").alias("text"))
