"""Full-text retrieval: which route's text counts, and why there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasift.functions import text as T


def outcomes(attempts: DataFrame, max_chars: int | None = None) -> DataFrame:
    """record_id, available, reason, text, source_url, n_chars, text_sha256 from what both routes gave.

    ``attempts``: record_id, abstract, pmcid, archive_text, archive_failed (a passing failure), open_url, open_status (ok, error
    or no_client), open_text. The archive comes first. A passing failure there doesn't stop the open route, but if that gives
    nothing either, the failure is the reason, so the record is tried again. Without a text the abstract stands in. Texts are
    whole unless ``max_chars`` says how much of them a reader downstream can take.
    """
    archive, opened = T.empty_to_null(F.col("archive_text")), F.when(F.col("open_status") == "ok", T.empty_to_null(F.col("open_text")))
    failed = F.coalesce(F.col("archive_failed"), F.lit(False))
    reason = (
        F.when(archive.isNotNull() | opened.isNotNull(), F.lit(None).cast("string"))
        .when(failed | (F.col("open_status") == "error"), "error_http")
        .when(F.coalesce(F.length("open_url"), F.lit(0)) == 0, "sin_url_oa")
        .when(F.col("open_status") == "no_client", "sin_httpx")
        .otherwise("texto_vacio")
    )
    text = F.coalesce(archive, opened)
    text = text if max_chars is None else F.substring(text, 1, max_chars)
    url = F.when(archive.isNotNull(), F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), "pmcid", F.lit("/"))).when(opened.isNotNull(), F.col("open_url"))
    kept = attempts.select("record_id", reason.alias("reason"), text.alias("kept"), url.alias("source_url"), F.coalesce("abstract", F.lit("")).alias("abstract"))
    there = F.col("reason").isNull()
    return kept.select("record_id", there.alias("available"), "reason", F.coalesce("kept", "abstract").alias("text"), "source_url", F.when(there, F.length("kept")).otherwise(0).alias("n_chars"), F.when(there, F.sha2("kept", 256)).alias("text_sha256"))
