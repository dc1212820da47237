"""Registered queries of the evidence-synthesis operators, each with its SQL.

The inputs are derived from the driver's tables: documents as records and texts, events as votes, calls and log lines,
lineitem as trial arms. Every derived column has the same rule in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metasift.functions import stats as S
from metasift.functions import text as T
from metasift.functions import vectors as V
from metasift.operators import agreement, audit, bindings, dedup, exports, flow, grounding, history, ledger, meta, nested, providers, retrieval, screening, searchlog
from metasift.operators.ordered import settled
from metasift.sources import records as R
from metasift.streaming import journal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- screening ---------------------------------------------------------------------------------------------------------


def _gold_and_decisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gold = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("record_id"), (F.col("quality") == 1).alias("relevant"))
    label = F.when(F.col("n_chars") >= 600, "include").when(F.col("n_chars") >= 300, "unclear").otherwise("exclude")
    decisions = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.col("doc_id").alias("seq"), label.alias("ensemble_label"))
    return gold, decisions


MATRIX_SQL = """
m AS (SELECT count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn, count(*) FILTER (NOT p AND NOT g) AS tn
      FROM (SELECT n_chars >= 300 AS p, quality = 1 AS g FROM labels JOIN documents USING (doc_id))),
d AS (SELECT *, tp::DOUBLE AS a, fp::DOUBLE AS b, fn::DOUBLE AS c, tn::DOUBLE AS e, (tp + fp + fn + tn)::DOUBLE AS t FROM m)
"""


@query(
    f"""WITH {MATRIX_SQL}
SELECT tp, fp, fn, tn, tp + fp + fn + tn AS n, a / nullif(a + c, 0) AS recall, c / nullif(a + c, 0) AS lost_evidence, a / nullif(a + b, 0) AS precision,
  (a * e - b * c) / nullif(sqrt((a + b) * (a + c) * (e + b) * (e + c)), 0) AS mcc,
  (a * e - b * c * 10) / nullif(sqrt((a + b) * (a + c * 10) * (e + b) * (e + c * 10)), 0) AS wmcc,
  ((a + e) / t - ((a + b) * (a + c) + (c + e) * (b + e)) / (t * t)) / nullif(1 - ((a + b) * (a + c) + (c + e) * (b + e)) / (t * t), 0) AS kappa,
  greatest(0.0, (a / (a + c) + 3.8416 / (2 * (a + c))) / (1 + 3.8416 / (a + c)) - 1.96 * sqrt(a / (a + c) * (1 - a / (a + c)) / (a + c) + 3.8416 / (4 * (a + c) * (a + c))) / (1 + 3.8416 / (a + c))) AS recall_low,
  least(1.0, (a / (a + c) + 3.8416 / (2 * (a + c))) / (1 + 3.8416 / (a + c)) + 1.96 * sqrt(a / (a + c) * (1 - a / (a + c)) / (a + c) + 3.8416 / (4 * (a + c) * (a + c))) / (1 + 3.8416 / (a + c))) AS recall_high
FROM d"""
)
def screening_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, decisions = _gold_and_decisions(spark, sf_dir)
    out = screening.screening_metrics(decisions, gold)
    return _rounded(out)


def _rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c, kind in df.dtypes if kind == "double"})


def _rounded_sql(sql: str, columns: str, doubles: str, places: int = 9) -> str:
    """The query with its doubles rounded, as _rounded does it."""
    plain = [c for c in columns.split() if c not in doubles.split()]
    return f"SELECT {', '.join([*plain, *(f'round({c}, {places}) AS {c}' for c in doubles.split())])} FROM ({sql})"


ORACLES["screening_metrics"] = _rounded_sql(ORACLES["screening_metrics"], "tp fp fn tn n recall lost_evidence precision mcc wmcc kappa recall_low recall_high", "recall lost_evidence precision mcc wmcc kappa recall_low recall_high")


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") == "purchase", "include").when(F.col("event_type") == "signup", "unclear").when(F.col("event_type").isin("view", "click"), "exclude")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), label.alias("label"), F.col("event_id").alias("seq"))


VOTES_SQL = "SELECT user_id AS record_id, CASE event_type WHEN 'purchase' THEN 'include' WHEN 'signup' THEN 'unclear' WHEN 'view' THEN 'exclude' WHEN 'click' THEN 'exclude' END AS label, event_id AS seq FROM events"


@query(
    f"""SELECT record_id, CASE WHEN coalesce(bool_or(label = 'include'), false) THEN 'include' WHEN coalesce(bool_or(label = 'unclear'), false) THEN 'unclear'
  WHEN coalesce(bool_and(label = 'exclude'), false) THEN 'exclude' ELSE 'unclear' END AS ensemble_label, count(label) AS n_votes FROM ({VOTES_SQL}) GROUP BY 1"""
)
def ensemble_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _votes(spark, sf_dir)
    return screening.ensemble(votes, votes.where("label IS NOT NULL"))


DECISIONS_SQL = """
decisions AS (SELECT doc_id AS record_id, doc_id AS seq, CASE WHEN doc_id % 5 < 2 THEN 'include' WHEN doc_id % 5 = 2 THEN 'unclear' ELSE 'exclude' END AS ensemble_label,
  CASE doc_id % 7 WHEN 0 THEN 'include' WHEN 1 THEN 'exclude' END AS human_label, text, lang, source FROM documents),
screened AS (SELECT *, coalesce(human_label, ensemble_label) AS final_label FROM decisions),
ft0 AS (SELECT record_id, seq, CASE WHEN record_id % 11 = 0 THEN NULL WHEN record_id % 3 = 0 THEN 'exclude' ELSE 'include' END AS ensemble_label, CASE record_id % 13 WHEN 0 THEN 'exclude' WHEN 1 THEN 'include' END AS human_label,
  CASE WHEN record_id % 26 = 0 THEN ' ' ELSE ' fuera de alcance ' END AS human_reason, CASE WHEN record_id % 11 = 0 THEN 'not_retrieved' ELSE 'retrieved' END AS fulltext_status,
  CASE WHEN lang = 'en' THEN '' ELSE ' ' || lang || ' ' END AS criterion, text FROM screened WHERE final_label IN ('include', 'unclear')),
fulltext AS (SELECT *, coalesce(human_label, ensemble_label) AS final_label FROM ft0),
reports AS (SELECT record_id, CASE WHEN coalesce(human_label = 'exclude', false) THEN coalesce(nullif(trim(human_reason), ''), 'criterio no especificado') ELSE coalesce(nullif(trim(criterion), ''), 'criterio no especificado') END AS reason,
  CASE WHEN coalesce(human_label = 'exclude', false) THEN 'human' ELSE 'ai' END AS reason_source, text AS title FROM fulltext WHERE final_label = 'exclude')
"""


def _decisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, title-and-abstract decisions and full-text decisions."""
    n = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").select(n.alias("record_id"), n.alias("seq"), F.col("text").alias("title"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("doi"), "lang", F.col("source").alias("source_db"))
    r = F.col("record_id")
    proposed = F.when(r % 5 < 2, "include").when(r % 5 == 2, "unclear").otherwise("exclude")
    human = F.when(r % 7 == 0, "include").when(r % 7 == 1, "exclude")
    decided = docs.select("record_id", "seq", "lang", proposed.alias("ensemble_label"), F.lit(None).cast("string").alias("fulltext_status"))
    labels = docs.select("record_id", human.alias("label"), F.lit(None).cast("string").alias("reason"), F.lit("human:x").alias("actor")).where("label IS NOT NULL")
    screened = screening.apply_labels(decided, labels)
    passed = screened.where(screening.passes(F.col("final_label"))).select("record_id", "seq", "lang")
    ft = passed.select(
        "record_id", "seq", F.when(r % 11 != 0, F.when(r % 3 == 0, "exclude").otherwise("include")).alias("ensemble_label"), F.when(r % 11 == 0, "not_retrieved").otherwise("retrieved").alias("fulltext_status"),
        F.array(F.lit(" "), F.when(F.col("lang") == "en", "").otherwise(F.concat(F.lit(" "), "lang", F.lit(" ")))).alias("criteria"),
    )
    ft_labels = passed.select("record_id", F.when(r % 13 == 0, "exclude").when(r % 13 == 1, "include").alias("label"), F.when(r % 26 == 0, " ").otherwise(" fuera de alcance ").alias("reason"), F.lit("human:x").alias("actor")).where("label IS NOT NULL")
    return docs, screened, screening.apply_labels(ft, ft_labels)


@query(
    f"""WITH {DECISIONS_SQL} SELECT count(*) FILTER (final_label = 'exclude') AS total_excluded,
  count(*) FILTER (final_label = 'exclude' AND coalesce(human_label <> 'exclude', true)) AS excluded_ai, count(*) FILTER (final_label = 'exclude' AND human_label = 'exclude') AS excluded_human,
  count(*) FILTER (ensemble_label = 'exclude' AND human_label = 'include') AS overridden_to_include, count(*) FILTER (ensemble_label IN ('include', 'unclear') AND human_label = 'exclude') AS overridden_to_exclude FROM screened"""
)
def exclusion_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.exclusion_breakdown(_decisions(spark, sf_dir)[1])


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _, ft = _decisions(spark, sf_dir)
    return screening.excluded_reports(ft, docs)


@query(f"WITH {DECISIONS_SQL} SELECT record_id, title, reason, reason_source FROM reports")
def excluded_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).select("record_id", "title", "reason", "reason_source")


@query(f"WITH {DECISIONS_SQL} SELECT reason, count(*) AS n FROM reports GROUP BY 1 ORDER BY 2 DESC, 1")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.reason_counts(_reports(spark, sf_dir))


@query(
    f"""WITH {DECISIONS_SQL}, ids AS (SELECT record_id, ensemble_label, fulltext_status FROM fulltext)
SELECT count(*) FILTER (fulltext_status = 'not_retrieved' OR ensemble_label = 'unclear') AS n_must, count(*) FILTER (fulltext_status = 'not_retrieved') AS n_lost, count(*) FILTER (ensemble_label = 'unclear') AS n_unclear FROM ids"""
)
def required_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = screening.required_labels(_decisions(spark, sf_dir)[2], "A1")
    return lists.select(F.size("must_label").cast("long").alias("n_must"), F.size("not_retrieved").cast("long").alias("n_lost"), F.size("unclear").cast("long").alias("n_unclear"))


@query(f"WITH {DECISIONS_SQL} SELECT record_id FROM screened WHERE ensemble_label = 'exclude' AND human_label IS NULL")
def unlabelled_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, screened, _ = _decisions(spark, sf_dir)
    return screening.unlabelled_ai_exclusions(screened, screened.where("human_label IS NOT NULL"))


# --- dedup -------------------------------------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: ids repeat, some titles are given as DOIs, one entry of ``extra`` is often empty."""
    n = F.col("doc_id")
    extra = F.create_map(F.lit("lang"), F.when(n % 3 == 0, "").otherwise(F.col("lang")), F.lit("src"), F.col("source"))
    return read(spark, sf_dir, "documents").select(n.alias("seq"), F.concat(F.lit("rec-"), (n % 300).cast("string")).alias("record_id"), F.col("text").alias("title"), F.when(n % 10 == 1, F.concat(F.lit(" 10.1/X"), (n % 40).cast("string"))).alias("doi"), F.col("source").alias("source_db"), extra.alias("extra"))


RECORDS_SQL = r"""
records AS (SELECT doc_id AS seq, 'rec-' || (doc_id % 300) AS record_id, text AS title, CASE WHEN doc_id % 10 = 1 THEN ' 10.1/X' || (doc_id % 40) END AS doi, source AS source_db,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS x_lang, source AS x_src FROM documents),
keyed AS (SELECT *, CASE WHEN length(doi) > 0 THEN 'doi:' || trim(lower(doi)) ELSE 'title:' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) END AS key FROM records),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS k FROM keyed),
kept AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY record_id ORDER BY seq) = 1 THEN record_id ELSE record_id || '#' || row_number() OVER (PARTITION BY record_id ORDER BY seq) END AS new_id FROM placed WHERE k = 1)
"""


@query(f"WITH {RECORDS_SQL}, g AS (SELECT key, count(*) AS n FROM keyed GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_in, count(*) AS n_out, CAST(sum(n - 1) AS BIGINT) AS n_discarded, CAST(coalesce(sum(n) FILTER (key = 'title:'), 0) AS BIGINT) AS n_blank FROM g")
def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_counts(_records(spark, sf_dir))


@query(
    f"""WITH {RECORDS_SQL}, e AS (SELECT key, arg_min(x_lang, seq) FILTER (x_lang <> '') AS lang, arg_min(x_src, seq) FILTER (x_src <> '') AS src FROM keyed GROUP BY 1)
SELECT k.seq, k.new_id AS record_id, md5(k.key) AS key_md5, k.source_db, e.lang, e.src FROM kept k JOIN e USING (key)"""
)
def dedup_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique, _, _ = dedup.deduplicate(_records(spark, sf_dir))
    value = lambda k: F.try_element_at("extra", F.lit(k)).alias(k)
    return unique.select("seq", "record_id", F.md5("key").alias("key_md5"), "source_db", value("lang"), value("src"))


@query(f"WITH {RECORDS_SQL} SELECT p.seq, p.record_id, p.source_db, k.new_id AS kept_record_id, md5(p.key) AS key_md5 FROM placed p JOIN kept k USING (key) WHERE p.k > 1")
def dedup_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, duplicates, _ = dedup.deduplicate(_records(spark, sf_dir))
    return duplicates.select("seq", "record_id", "source_db", "kept_record_id", F.md5("key").alias("key_md5"))


@query(f"WITH {RECORDS_SQL} SELECT seq, record_id AS from_id, new_id AS to_id FROM kept WHERE new_id <> record_id")
def dedup_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(_records(spark, sf_dir))[2]


# --- meta-analysis -----------------------------------------------------------------------------------------------------


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One study for each supplier nation, one review for each region; odd lines are the treated arm."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_linenumber") % 2 == 1).alias("treated"), (F.col("l_returnflag") == "R").alias("event"), "l_extendedprice")
    # reduced by supplier first: what is joined is small
    per = lines.groupBy("l_suppkey", "treated").agg(F.count(F.lit(1)).alias("n"), F.count_if("event").alias("e"), F.sum("l_extendedprice").alias("s"), F.sum(F.col("l_extendedprice") * F.col("l_extendedprice")).alias("ss"))
    suppliers = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "n_regionkey")
    rows = per.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    arm = lambda c, t: F.sum(F.when(F.col("treated") == t, F.col(c)))
    studies = rows.groupBy(F.col("n_regionkey").alias("review"), F.col("n_name").alias("study_id")).agg(*[arm(c, t).alias(f"{c}{k}") for c in ("n", "e", "s", "ss") for k, t in ((1, True), (0, False))])
    mean = lambda k: F.col(f"s{k}") / F.col(f"n{k}")
    sd = lambda k: F.sqrt((F.col(f"ss{k}") - F.col(f"s{k}") * F.col(f"s{k}") / F.col(f"n{k}")) / (F.col(f"n{k}") - 1))
    full = studies.where("n1 > 1 AND n0 > 1")
    return full.select("review", "study_id", "e1", "n1", "e0", "n0", mean(1).alias("m1"), sd(1).alias("sd1"), F.col("n1").alias("cn1"), mean(0).alias("m0"), sd(0).alias("sd0"), F.col("n0").alias("cn0"))


ARMS_SQL = """
arms AS (SELECT n_regionkey AS review, n_name AS study_id, l_linenumber % 2 = 1 AS t, l_returnflag = 'R' AS ev, l_extendedprice AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
studies AS (SELECT review, study_id, count(*) FILTER (t AND ev) AS e1, count(*) FILTER (t) AS n1, count(*) FILTER (NOT t AND ev) AS e0, count(*) FILTER (NOT t) AS n0,
  avg(x) FILTER (t) AS m1, stddev_samp(x) FILTER (t) AS sd1, avg(x) FILTER (NOT t) AS m0, stddev_samp(x) FILTER (NOT t) AS sd0 FROM arms GROUP BY 1, 2 HAVING n1 > 1 AND n0 > 1),
logor AS (SELECT review, study_id, ln((e1 + h) * (n0 - e0 + h) / ((n1 - e1 + h) * (e0 + h))) AS yi, 1 / (e1 + h) + 1 / (n1 - e1 + h) + 1 / (e0 + h) + 1 / (n0 - e0 + h) AS vi
  FROM (SELECT *, CASE WHEN least(e1, n1 - e1, e0, n0 - e0) = 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS h FROM studies)),
md AS (SELECT review, study_id, m1 - m0 AS yi, sd1 * sd1 / n1 + sd0 * sd0 / n0 AS vi FROM studies),
smd AS (SELECT review, study_id, g AS yi, (n1 + n0) / (n1::DOUBLE * n0) + g * g / (2 * (n1 + n0)) AS vi FROM (SELECT *,
  (m1 - m0) / sqrt(((n1 - 1) * sd1 * sd1 + (n0 - 1) * sd0 * sd0) / (n1 + n0 - 2)) * (1 - 3 / (4 * (n1 + n0)::DOUBLE - 9)) AS g FROM studies))
"""

POOL_SQL = """
f AS (SELECT review, count(*) AS k, sum(1 / vi) AS sw, sum(yi / vi) / sum(1 / vi) AS mean_fixed, sum(1 / (vi * vi)) AS sww FROM {m} GROUP BY 1),
het AS (SELECT review, f.k, f.sw, f.mean_fixed, q, f.k - 1 AS df, CASE WHEN sw - sww / sw > 0 THEN greatest(0.0, (q - (f.k - 1)) / (sw - sww / sw)) ELSE 0.0 END AS tau2,
  CASE WHEN q > 0 THEN greatest(0.0, (q - (f.k - 1)) / q) * 100 ELSE 0.0 END AS i2 FROM f JOIN (SELECT review, sum((yi - mean_fixed) * (yi - mean_fixed) / vi) AS q FROM {m} JOIN f USING (review) GROUP BY 1) USING (review)),
pooled AS (SELECT review, model, k, swy / sw2 AS estimate, sqrt(1 / sw2) AS se, swy / sw2 - 1.96 * sqrt(1 / sw2) AS ci_low, swy / sw2 + 1.96 * sqrt(1 / sw2) AS ci_high, swy / sw2 / sqrt(1 / sw2) AS z, q, df, tau2, i2
  FROM (SELECT review, model, sum(w) AS sw2, sum(w * yi) AS swy FROM (SELECT review, yi, 'fixed' AS model, 1 / vi AS w FROM {m} UNION ALL SELECT review, yi, 'random', 1 / (vi + tau2) FROM {m} JOIN het USING (review)) GROUP BY 1, 2) JOIN het USING (review) WHERE k >= 2)
"""
POOLED = ("review model k estimate se ci_low ci_high z q df tau2 i2", "estimate se ci_low ci_high z q tau2 i2")


def _pooled_sql(measure: str) -> str:
    return _rounded_sql(f"WITH {ARMS_SQL}, {POOL_SQL.format(m=measure)} SELECT * FROM pooled", *POOLED, places=6)


def _pooled(spark: SparkSession, sf_dir: str, measure: str) -> DataFrame:
    return _rounded(meta.pooled(meta.effect_sizes(_arms(spark, sf_dir), measure), ["review"]), 6)


@query(_pooled_sql("logor"))
def meta_logor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(spark, sf_dir, "logOR")


@query(_pooled_sql("md"))
def meta_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(spark, sf_dir, "MD")


@query(_pooled_sql("smd"))
def meta_smd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(spark, sf_dir, "SMD")


@query(
    _rounded_sql(
        f"""WITH {ARMS_SQL}, {POOL_SQL.format(m="logor")}, r AS (SELECT *, 1 / (vi + tau2) AS wr FROM logor JOIN het USING (review))
SELECT review, study_id, 1 / (1 + exp(-yi)) AS yi, vi, sqrt(vi) AS se, 1 / (1 + exp(-(yi - 1.96 * sqrt(vi)))) AS ci_low, 1 / (1 + exp(-(yi + 1.96 * sqrt(vi)))) AS ci_high, 100 / vi / sw AS weight_fixed, 100 * wr / sum(wr) OVER (PARTITION BY review) AS weight_random FROM r""",
        "review study_id yi vi se ci_low ci_high weight_fixed weight_random",
        "yi vi se ci_low ci_high weight_fixed weight_random",
    )
)
def forest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    studies = meta.study_rows(meta.effect_sizes(_arms(spark, sf_dir), "logOR"), ["review"])
    return _rounded(meta.forest(studies, "proportion"))


def _simpson(f: str, upper: str, n: int = 2000) -> str:
    """Simpson's rule over [0, upper] in DuckDB; ``f`` is an expression of u."""
    u = f"({upper}) * i / {n}.0"
    weight = f"CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(({upper}) / {3 * n}.0 * list_sum(list_transform(range(0, {n + 1}), lambda i: ({weight}) * ({f.replace('{u}', '(' + u + ')')}))))"


#: Tails by integration, where the operators use series and finite sums.
NORMAL_P_SQL = "1 - 2 / sqrt(2 * pi()) * " + _simpson("exp(-{u} * {u} / 2)", "least(abs(z), 9.0)")
STUDENT_P_SQL = "1 - " + _simpson("pow(cos({u}), k - 3)", "atan(abs(t) / sqrt(k - 2))") + " / " + _simpson("pow(cos({u}), k - 3)", "pi() / 2")
CHI2_P_SQL = "1 - 2 / (pow(2, df / 2.0) * gamma(df / 2.0)) * " + _simpson("pow({u}, df - 1) * exp(-{u} * {u} / 2)", "least(sqrt(q), sqrt(df) + 12)")

EGGER_SQL = f"""WITH {ARMS_SQL}, p AS (SELECT review, 1 / sqrt(vi) AS x, yi / sqrt(vi) AS y FROM logor),
l AS (SELECT review, count(*) AS k, regr_intercept(y, x) AS intercept, regr_slope(y, x) AS slope, regr_sxx(y, x) AS sxx, avg(x) AS mx FROM p GROUP BY 1 HAVING count(*) >= 3 AND regr_sxx(y, x) > 0),
s AS (SELECT review, sum((y - intercept - slope * x) * (y - intercept - slope * x)) AS ss FROM p JOIN l USING (review) GROUP BY 1),
e AS (SELECT review, k, intercept, slope, sqrt(ss / (k - 2) * (1 / k::DOUBLE + mx * mx / sxx)) AS se, intercept / sqrt(ss / (k - 2) * (1 / k::DOUBLE + mx * mx / sxx)) AS t FROM l JOIN s USING (review))
SELECT *, {STUDENT_P_SQL} AS p_value FROM e"""


@query(_rounded_sql(EGGER_SQL, "review k intercept slope se t p_value", "intercept slope se t p_value", 6))
def egger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(meta.egger(meta.effect_sizes(_arms(spark, sf_dir), "logOR"), ["review"], p_values=True), 6)


@query(_rounded_sql(f"WITH {ARMS_SQL}, {POOL_SQL.format(m='md')} SELECT *, {NORMAL_P_SQL} AS p_value, {CHI2_P_SQL} AS q_p_value FROM pooled", f"{POOLED[0]} p_value q_p_value", f"{POOLED[1]} p_value q_p_value", places=6))
def meta_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(meta.pooled(meta.effect_sizes(_arms(spark, sf_dir), "MD"), ["review"], p_values=True), 6)


# --- extraction --------------------------------------------------------------------------------------------------------


@query("SELECT record_id, pos FROM (SELECT doc_id AS record_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n, greatest(1, CAST(ceil(0.2 * count(*) OVER ()) AS BIGINT)) AS k FROM documents) WHERE k >= n OR pos IN (SELECT least(n2 - 1, CAST(trunc(i * (n2::DOUBLE / k2)) AS BIGINT)) FROM (SELECT count(*) AS n2, greatest(1, CAST(ceil(0.2 * count(*)) AS BIGINT)) AS k2 FROM documents), range(0, k2) r(i))")
def double_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.systematic_sample(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id")), "record_id")


@query(
    _rounded_sql(
        """WITH p AS (SELECT doc_id AS s, k, v FROM (SELECT doc_id, unnest(['lang', 'source', 'size']) AS k, unnest([lang, source, CASE WHEN n_chars > 900 THEN 'long' END]) AS v FROM documents WHERE doc_id % 4 <> 0)),
q AS (SELECT doc_id AS s, k, v FROM (SELECT doc_id, unnest(['lang', 'source', 'note']) AS k, unnest(['  ' || upper(lang) || ' ', CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE source END, CASE WHEN n_chars > 900 THEN 'x' END]) AS v FROM documents WHERE doc_id % 4 <> 1)),
c AS (SELECT DISTINCT s FROM p INTERSECT SELECT DISTINCT s FROM q),
j AS (SELECT coalesce(p.s, q.s) AS s, nullif(trim(lower(p.v)), '') AS a, nullif(trim(lower(q.v)), '') AS b FROM (SELECT * FROM p WHERE s IN (SELECT s FROM c)) p FULL JOIN (SELECT * FROM q WHERE s IN (SELECT s FROM c)) q ON p.s = q.s AND p.k = q.k),
m AS (SELECT count(DISTINCT s) AS n_studies, count(*) AS n_field_pairs, count(*) FILTER (a = b) AS n_value_match, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL)::DOUBLE AS tp, count(*) FILTER (a IS NOT NULL AND b IS NULL)::DOUBLE AS fp,
  count(*) FILTER (a IS NULL AND b IS NOT NULL)::DOUBLE AS fn, count(*) FILTER (a IS NULL AND b IS NULL)::DOUBLE AS tn FROM j)
SELECT n_studies, n_field_pairs, n_value_match, n_value_match / n_field_pairs::DOUBLE AS value_agreement,
  ((tp + tn) / n_field_pairs - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n_field_pairs::DOUBLE * n_field_pairs)) / nullif(1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n_field_pairs::DOUBLE * n_field_pairs), 0) AS presence_kappa FROM m""",
        "n_studies n_field_pairs n_value_match value_agreement presence_kappa",
        "value_agreement presence_kappa",
    )
)
def extraction_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    long = F.col("n_chars") > 900
    fields = lambda df, **values: df.select(F.col("doc_id").alias("study_id"), F.inline(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])))
    first = fields(docs.where("doc_id % 4 <> 0"), lang=F.col("lang"), source=F.col("source"), size=F.when(long, "long"))
    second = fields(docs.where("doc_id % 4 <> 1"), lang=F.concat(F.lit("  "), F.upper("lang"), F.lit(" ")), source=F.when(F.col("doc_id") % 3 == 0, "other").otherwise(F.col("source")), note=F.when(long, "x"))
    return _rounded(agreement.agreement(first, second))


# --- vectors and grounding ---------------------------------------------------------------------------------------------

EMBED_SQL = """
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-záéíóúñü0-9]+')) AS t FROM {table}),
cnt AS (SELECT doc_id, CAST(('0x' || substr(md5(t), 30, 3))::INT % 512 AS INT) AS bucket, count(*) AS n FROM tok GROUP BY 1, 2),
vec AS (SELECT doc_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS weight FROM cnt)
"""


@query(f"WITH {EMBED_SQL.format(table='documents')} SELECT doc_id, bucket, round(weight, 9) AS weight FROM vec")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.hash_embed(read(spark, sf_dir, "documents"), "doc_id", "text"))


@query(
    f"""WITH {EMBED_SQL.format(table="documents")}, p AS (SELECT a.doc_id AS doc_id, b.doc_id AS other_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
s AS (SELECT p.doc_id, p.other_id, sum(x.weight * y.weight) AS similarity FROM p JOIN vec x ON x.doc_id = p.doc_id JOIN vec y ON y.doc_id = p.other_id AND y.bucket = x.bucket GROUP BY 1, 2)
SELECT doc_id, other_id, round(coalesce(similarity, 0), 9) AS similarity, coalesce(similarity, 0) >= 0.12 AS grounded FROM p LEFT JOIN s USING (doc_id, other_id)"""
)
def hash_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    # settled, so that each text is made a vector once though both sides of the join want it
    vectors = settled(V.with_vector(docs, "text", "vector").select("doc_id", "vector"))
    pairs = vectors.join(vectors.select(F.col("doc_id").alias("other_id"), F.col("vector").alias("other")), F.col("other_id") == F.col("doc_id") + 1)
    scored = pairs.withColumn("similarity", V.sparse_dot(F.col("vector"), F.col("other")))
    return scored.select("doc_id", "other_id", F.round("similarity", 9).alias("similarity"), (F.col("similarity") >= grounding.THRESHOLD).alias("grounded"))


@query("SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(similarity, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)) WHERE rank <= 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return _rounded(grounding.most_similar(vectors.where("vec_id % 20 = 0"), vectors, 5))


NARRATIVES_SQL = """
n AS (SELECT doc_id, text || ' [rec-' || doc_id || '] ' || text || ' [rec-' || (doc_id + 1) || '] x [rec-' || doc_id || '] [none:' || (doc_id % 7) || ']' AS text FROM documents),
c AS (SELECT doc_id, text, unnest(ids) AS cited_id, unnest(range(0, len(ids))) AS pos FROM (SELECT doc_id, text, ['rec-' || doc_id, 'rec-' || (doc_id + 1), 'none:' || (doc_id % 7)] AS ids FROM n)),
claims AS (SELECT doc_id, CAST(pos AS INT) AS pos, cited_id, trim(substr(text, greatest(1, p0 - 120), p0 + length(cited_id) + 122 - greatest(1, p0 - 120)), ' ' || chr(10)) AS claim FROM (SELECT *, strpos(text, '[' || cited_id || ']') AS p0 FROM c))
"""


def _narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    tag = lambda prefix, x: F.concat(F.lit(f"[{prefix}"), x.cast("string"), F.lit("]"))
    text = F.concat("text", F.lit(" "), tag("rec-", n), F.lit(" "), "text", F.lit(" "), tag("rec-", n + 1), F.lit(" x "), tag("rec-", n), F.lit(" "), tag("none:", n % 7))
    return read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query(f"WITH {NARRATIVES_SQL} SELECT doc_id, pos, cited_id, md5(claim) AS claim_md5 FROM claims")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.cited(_narratives(spark, sf_dir)).select("doc_id", "pos", "cited_id", F.md5("claim").alias("claim_md5"))


@query(
    f"""WITH {NARRATIVES_SQL}, corpus AS (SELECT 'rec-' || doc_id AS record_id, CASE WHEN doc_id % 9 <> 0 THEN text END AS source FROM documents),
ct AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(claim), '[a-záéíóúñü0-9]+')) AS t FROM claims),
cv AS (SELECT doc_id, pos, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, pos)) AS w FROM (SELECT doc_id, pos, ('0x' || substr(md5(t), 30, 3))::INT % 512 AS bucket, count(*) AS n FROM ct GROUP BY ALL)),
st AS (SELECT record_id, unnest(regexp_extract_all(lower(source), '[a-záéíóúñü0-9]+')) AS t FROM corpus),
sv AS (SELECT record_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY record_id)) AS w FROM (SELECT record_id, ('0x' || substr(md5(t), 30, 3))::INT % 512 AS bucket, count(*) AS n FROM st GROUP BY ALL)),
sim AS (SELECT c.doc_id, c.pos, sum(cv.w * sv.w) AS s FROM claims c JOIN cv USING (doc_id, pos) JOIN sv ON sv.record_id = c.cited_id AND sv.bucket = cv.bucket GROUP BY 1, 2),
checks AS (SELECT doc_id, pos, record_id IS NOT NULL AS ex, record_id IS NOT NULL AND (source IS NULL OR coalesce(s, 0) >= 0.12) AS gr FROM claims LEFT JOIN corpus ON record_id = cited_id LEFT JOIN sim USING (doc_id, pos))
SELECT doc_id, count(*) AS n_checks, count(*) FILTER (NOT ex OR NOT gr) AS n_flagged, bool_or(NOT ex OR NOT gr) AS hallucination_flagged FROM checks GROUP BY 1"""
)
def grounding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    corpus = read(spark, sf_dir, "documents").select(F.concat(F.lit("rec-"), n.cast("string")).alias("record_id"), F.when(n % 9 != 0, F.col("text")).alias("source"))
    checks = grounding.verify(grounding.cited(_narratives(spark, sf_dir)), corpus)
    return grounding.reports(checks).drop("flagged_positions")


# --- text functions ----------------------------------------------------------------------------------------------------


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.md5(T.page_text(F.col("html"))).alias("text_md5"))


@query(
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(t, '(//)[^/\s:@''"]+:[^/\s@''"]+@', '\1<redacted>@', 'g'), '(?i)((?:api_key|apikey|key|token|access_token|mailto|email|x-amz-signature|x-amz-credential|x-amz-security-token|signature|policy|key-pair-id|sig|client_secret|secret|password)=)[^&\s''"]+', '\1<redacted>', 'g')) AS redacted_md5
FROM (SELECT doc_id, text || ' https://u' || doc_id || ':pw@h.org/p?token=abc' || doc_id || '&x=1 password=' || doc_id AS t FROM documents)"""
)
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    text = F.concat("text", F.lit(" https://u"), n, F.lit(":pw@h.org/p?token=abc"), n, F.lit("&x=1 password="), n)
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.redact(text)).alias("redacted_md5"))


@query(
    r"""WITH d AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'https://doi.org/10.1/A' WHEN 1 THEN 'doi:10.2/B' WHEN 2 THEN 'HTTP://DOI.ORG/10.3/C' WHEN 3 THEN 'http://dx.doi.org/10.4/D' WHEN 4 THEN '' ELSE ' 10.5/E ' END || CASE WHEN doc_id % 6 = 4 THEN '' ELSE doc_id::VARCHAR END AS v, text, doc_id % 6 AS m FROM documents)
SELECT doc_id, nullif(trim(lower(replace(v, 'https://doi.org/', ''))), '') AS index_doi,
  CASE m WHEN 0 THEN '10.1/a' || doc_id WHEN 1 THEN '10.2/b' || doc_id WHEN 2 THEN '10.3/c' || doc_id WHEN 5 THEN '10.5/e ' || doc_id END AS repository_doi,
  CASE WHEN length(v) > 0 THEN trim(replace(lower(v), 'https://doi.org/', '')) ELSE 'hash:' || left(sha256(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))), 16) END AS import_id FROM d"""
)
def doi_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    forms = ["https://doi.org/10.1/A", "doi:10.2/B", "HTTP://DOI.ORG/10.3/C", "http://dx.doi.org/10.4/D", "", " 10.5/E "]
    form = F.get(F.array(*[F.lit(f) for f in forms]), (n % 6).cast("int"))
    value = F.concat(form, F.when(n % 6 == 4, "").otherwise(n.cast("string")))
    return read(spark, sf_dir, "documents").select("doc_id", T.index_doi(value).alias("index_doi"), T.repository_doi(value).alias("repository_doi"), T.import_id(value, F.col("text")).alias("import_id"))


@query(
    r"""SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS title_key, nullif(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '') AS compared,
  TRY_CAST(nullif(regexp_extract(text, '[0-9]{4}', 0), '') AS INT) AS any_year, 'c' || doc_id || '_x' AS cite_key, regexp_replace(text, '[;,]', ' - ', 'g') <> text AS has_separator,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 28 END AS day_gap FROM documents"""
)
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, head = F.col("doc_id"), F.col("text")
    key = F.concat(F.lit("/c"), n.cast("string"), F.lit("-x."))
    late = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 28).cast("int")), "yyyy-MM-dd")
    typed = F.when(n % 3 == 0, "soon").otherwise(late)
    return read(spark, sf_dir, "documents").select(
        "doc_id", T.title_key(head).alias("title_key"), T.compared_value(head).alias("compared"), T.any_year(F.col("text")).alias("any_year"), T.cite_key(key).alias("cite_key"),
        (F.regexp_replace("text", "[;,]", " - ") != F.col("text")).alias("has_separator"), T.days_between(typed, F.lit("2024-01-01")).cast("long").alias("day_gap"),
    )


@query("SELECT doc_id, round(1 / (1 + exp(-(n_chars / 1000.0))), 9) AS p, CASE WHEN doc_id % 100 BETWEEN 1 AND 99 THEN CAST(ceil(round(1 / (1 - (doc_id % 100) / 100.0::DOUBLE), 9)) AS BIGINT) END AS least_positives, abs((doc_id % 5) / 2.0 - 1) <= 1 AS correlation FROM documents")
def scalar_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    target = (n % 100) / F.lit(100.0)
    return read(spark, sf_dir, "documents").select("doc_id", F.round(S.expit(F.col("n_chars") / 1000.0), 9).alias("p"), S.least_positives(target).alias("least_positives"), S.is_correlation((n % 5) / 2.0 - 1).alias("correlation"))


# --- log, calls, history -----------------------------------------------------------------------------------------------

LOG_SQL = """
log AS (SELECT ['screening_ta', 'screening_ft', 'extraction', 'rob', 'report'][1 + user_id % 5] AS stage, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'signup' THEN 'reject' WHEN 'error' THEN 'flag_review' ELSE 'label' END AS action,
  'human:u' || (user_id % 9) AS actor, 'A1' AS autonomy, 't' || (event_id % 50) AS target, 'r' || (user_id % 3) AS request_sha256, CASE WHEN event_id % 17 <> 0 THEN 'd' || (user_id % 4) END AS decision_sha256,
  CASE WHEN value > 50 THEN 'include' ELSE 'exclude' END AS to_label, event_id AS seq, CASE WHEN event_id % 13 = 0 THEN ts - INTERVAL 1 HOUR ELSE ts END AS ts FROM events),
eff AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY seq DESC) AS n FROM log WHERE action IN ('approve', 'reject', 'auto-proceed')) WHERE n = 1)
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, e, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    stage = F.get(F.array(*[F.lit(s) for s in ledger.STAGES]), (u % 5).cast("int"))
    action = F.when(kind == "purchase", "approve").when(kind == "signup", "reject").when(kind == "error", "flag_review").otherwise("label")
    tag = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    return read(spark, sf_dir, "events").select(
        stage.alias("stage"), action.alias("action"), tag("human:u", u % 9).alias("actor"), F.lit("A1").alias("autonomy"), tag("t", e % 50).alias("target"), tag("r", u % 3).alias("request_sha256"),
        F.when(e % 17 != 0, tag("d", u % 4)).alias("decision_sha256"), F.when(F.col("value") > 50, "include").otherwise("exclude").alias("to_label"), F.lit(None).cast("string").alias("reason"),
        e.alias("seq"), F.when(e % 13 == 0, F.col("ts") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts")).alias("ts"),
    )


@query(
    f"""WITH {LOG_SQL}, c AS (SELECT stage, decision_sha256, count(*) FILTER (action = 'label') AS nl, count(*) FILTER (action = 'flag_review') AS nf FROM log GROUP BY 1, 2)
SELECT e.stage, e.action, e.actor, e.autonomy, e.request_sha256, e.decision_sha256, coalesce(nl, 0) AS n_labels, coalesce(nf, 0) AS n_flag_reviews, e.seq FROM eff e LEFT JOIN c ON c.stage = e.stage AND c.decision_sha256 = e.decision_sha256"""
)
def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.gate_summary(_log(spark, sf_dir))


@query(
    f"""WITH {LOG_SQL} SELECT l.stage, l.target, arg_max(l.to_label, l.seq) AS label, arg_max(l.actor, l.seq) AS actor FROM log l JOIN eff e ON l.stage = e.stage AND l.request_sha256 IS NOT DISTINCT FROM e.request_sha256
AND l.decision_sha256 IS NOT DISTINCT FROM e.decision_sha256 WHERE l.action = 'label' GROUP BY 1, 2"""
)
def labels_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.labels_from_log(_log(spark, sf_dir)).drop("reason")


@query(f"WITH {LOG_SQL} SELECT stage, seq, latest_before FROM (SELECT *, max(ts) OVER (PARTITION BY stage ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_before FROM log) WHERE latest_before - ts > INTERVAL 2 SECONDS")
def ledger_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.late_marks(_log(spark, sf_dir), ["stage"]).select("stage", "seq", "latest_before")


@query(
    f"""WITH {LOG_SQL}, c AS (SELECT stage, decision_sha256, min(seq) AS closed, bool_or(action = 'reject') AS rejected FROM log WHERE action IN ('approve', 'reject') GROUP BY 1, 2),
m AS (SELECT l.*, closed, rejected FROM log l LEFT JOIN c ON c.stage = l.stage AND c.decision_sha256 = l.decision_sha256 WHERE l.action IN ('label', 'flag_review'))
SELECT stage, problem, count(*) AS n FROM (SELECT stage, 'after closing' AS problem FROM m WHERE seq > closed UNION ALL SELECT stage, 'with a rejection' FROM m WHERE rejected
UNION ALL SELECT stage, 'repeated' FROM (SELECT stage, row_number() OVER (PARTITION BY stage, action, target, request_sha256, decision_sha256 ORDER BY seq) AS n FROM log) WHERE n > 1) GROUP BY 1, 2"""
)
def label_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.label_breaks(_log(spark, sf_dir)).groupBy("stage", "problem").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {LOG_SQL}, w AS (SELECT DISTINCT stage, action, target, request_sha256, decision_sha256 FROM log WHERE seq % 2 = 0), h AS (SELECT DISTINCT stage, action, target, request_sha256, decision_sha256 FROM log WHERE seq % 2 = 1)
SELECT stage, count(*) AS n FROM (SELECT * FROM w EXCEPT SELECT * FROM h) GROUP BY 1"""
)
def idempotent_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return ledger.missing_entries(log.where("seq % 2 = 1"), log.where("seq % 2 = 0")).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def _calls(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    u = F.col("user_id")
    return read(spark, sf_dir, "events").select(*more, F.concat(F.lit("m"), (u % 6).cast("string")).alias("model"), F.when(u % 2 == 0, "fake").otherwise("remote").alias("provider"), (u % 2 == 0).alias("deterministic"), F.sha2((F.col("event_id") % 400).cast("string"), 256).alias("response_sha256"), F.col("ts"))


CALLS_SQL = "calls AS (SELECT 'm' || (user_id % 6) AS model, CASE WHEN user_id % 2 = 0 THEN 'fake' ELSE 'remote' END AS provider, user_id % 2 = 0 AS deterministic, sha256((event_id % 400)::VARCHAR) AS response_sha256, ts FROM events)"


@query(
    f"""WITH {CALLS_SQL}, g AS (SELECT model, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY model ORDER BY ts))) / 1000.0 AS gap FROM calls)
SELECT model, count(ts) AS n_calls, round(quantile_cont(gap::DOUBLE, 0.5), 6) AS median_gap_ms, count(*) FILTER (epoch_us(ts) % 1000000 = 0) AS n_whole_seconds,
  coalesce(count(ts) >= 20 AND quantile_cont(gap::DOUBLE, 0.5) < 5, false) AS too_fast, count(ts) >= 4 AND count(*) FILTER (epoch_us(ts) % 1000000 = 0) * 2 >= count(ts) AS rounded FROM g GROUP BY 1"""
)
def call_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ledger.call_gaps(_calls(spark, sf_dir), ["model"]), 6)


@query(
    f"""WITH {CALLS_SQL}, p AS (SELECT model, count(*) AS n, count(DISTINCT response_sha256) AS d FROM calls GROUP BY 1 HAVING count(*) >= 10), h AS (SELECT DISTINCT model, response_sha256 FROM calls WHERE model IN (SELECT model FROM p))
SELECT a.model AS model_a, b.model AS model_b, count(*) AS shared, round(count(*) / least(any_value(pa.d), any_value(pb.d))::DOUBLE, 9) AS overlap, count(*) / least(any_value(pa.d), any_value(pb.d))::DOUBLE >= 0.5 AS suspicious
FROM h a JOIN h b ON a.response_sha256 = b.response_sha256 AND a.model < b.model JOIN p pa ON pa.model = a.model JOIN p pb ON pb.model = b.model GROUP BY 1, 2"""
)
def response_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ledger.response_overlap(_calls(spark, sf_dir)))


@query(f"WITH {CALLS_SQL} SELECT list_sort(list(DISTINCT provider || ':' || model)) AS models_used, bool_and(deterministic) AS all_deterministic, count(*) AS n_calls FROM calls")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.manifest(_calls(spark, sf_dir))


RUNS_SQL = "prev AS (SELECT DISTINCT user_id AS record_id FROM events WHERE ts < (SELECT min(ts) + (max(ts) - min(ts)) / 50 FROM events)), cur AS (SELECT DISTINCT user_id AS record_id FROM events WHERE ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 50 FROM events))"


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = read(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    half = events.agg((F.min("us") + (F.max("us") - F.min("us")) / 50).alias("half"))
    split = events.crossJoin(F.broadcast(half)).select(F.col("user_id").alias("record_id"), (F.col("us") < F.col("half")).alias("early"))
    return split.where("early").select("record_id"), split.where("NOT early").select("record_id")


@query(f"WITH {RUNS_SQL} SELECT record_id, 'new' AS change FROM cur WHERE record_id NOT IN (SELECT record_id FROM prev) UNION ALL SELECT record_id, 'dropped' FROM prev WHERE record_id NOT IN (SELECT record_id FROM cur)")
def living_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.living_delta(*_runs(spark, sf_dir))


@query(f"WITH {RUNS_SQL}, n AS (SELECT count(*) AS new_included FROM cur WHERE record_id NOT IN (SELECT record_id FROM prev)), d AS (SELECT count(*) AS dropped FROM prev WHERE record_id NOT IN (SELECT record_id FROM cur)) SELECT (SELECT count(*) FROM prev) AS previous_included, new_included, dropped, (SELECT count(*) FROM prev) - dropped + new_included AS total_included FROM n, d")
def updated_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.updated_flow(*_runs(spark, sf_dir))


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    ids = F.array_sort(F.array_distinct(F.array(*[F.concat(F.lit("c"), ((F.col("o_custkey") + k * F.col("o_orderkey")) % 12).cast("string")) for k in range(4)])))
    return orders.select(F.concat(F.lit("s"), (F.col("o_custkey") % 50).cast("string")).alias("slug"), F.col("o_orderkey").alias("seq"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"), ids.alias("included_ids"))


MEMORY_SQL = "ev AS (SELECT 's' || (o_custkey % 50) AS slug, o_orderkey AS seq, strftime(o_orderdate, '%Y-%m-%d') AS ts, list_sort(list_distinct(['c' || (o_custkey % 12), 'c' || ((o_custkey + o_orderkey) % 12), 'c' || ((o_custkey + 2 * o_orderkey) % 12), 'c' || ((o_custkey + 3 * o_orderkey) % 12)])) AS ids FROM orders)"


@query(f"WITH {MEMORY_SQL} SELECT slug, count(*) AS n_runs, arg_max(ts, seq) AS last_ts, arg_max(ids, seq) AS last_included, min(seq) AS first_seq FROM ev GROUP BY 1")
def brain_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recall(_memory(spark, sf_dir))


@query(
    f"""WITH {MEMORY_SQL}, old AS (SELECT * FROM ev WHERE seq % 10 <> 0), arr AS (SELECT * FROM ev WHERE seq % 10 = 0), last AS (SELECT slug, arg_max(ids, seq) AS before FROM old GROUP BY 1)
SELECT a.slug, a.seq, list_sort(list_filter(a.ids, lambda x: NOT list_contains(coalesce(before, []), x))) AS included_new, list_sort(list_filter(coalesce(before, []), lambda x: NOT list_contains(a.ids, x))) AS included_dropped
FROM arr a LEFT JOIN last USING (slug) WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.slug = a.slug AND o.ts = a.ts)"""
)
def brain_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _memory(spark, sf_dir)
    return history.with_delta(events.where("seq % 10 <> 0"), events.where("seq % 10 = 0")).select("slug", "seq", "included_new", "included_dropped")


# --- flow and exports --------------------------------------------------------------------------------------------------

COUNTS_SQL = f"""{RECORDS_SQL}, {DECISIONS_SQL},
counts AS (SELECT (SELECT count(*) FROM records) AS identified, (SELECT count(*) FROM screened) AS screened, (SELECT count(*) FROM screened WHERE final_label = 'exclude') AS excluded_ta,
  (SELECT count(*) FROM screened WHERE final_label = 'exclude' AND human_label = 'exclude') AS excluded_ta_human, (SELECT count(*) FROM screened WHERE final_label = 'exclude' AND coalesce(human_label <> 'exclude', true)) AS excluded_ta_ai,
  (SELECT count(*) FROM fulltext) AS fulltext_sought, (SELECT count(*) FROM fulltext WHERE fulltext_status = 'not_retrieved' AND human_label IS NULL) AS fulltext_not_retrieved,
  (SELECT count(*) FROM fulltext WHERE fulltext_status = 'not_retrieved' AND human_label IS NOT NULL) AS fulltext_rescued, (SELECT count(*) FROM fulltext WHERE final_label = 'include') AS included,
  (SELECT count(*) FROM reports) AS excluded_ft, (SELECT count(*) FROM reports WHERE reason_source = 'human') AS excluded_ft_human, (SELECT count(*) FROM reports WHERE reason_source = 'ai') AS excluded_ft_ai)"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, screened, ft = _decisions(spark, sf_dir)
    return flow.flow_counts(docs, docs, screened, ft, screening.excluded_reports(ft, docs))


@query(
    f"""WITH {COUNTS_SQL}, l AS (UNPIVOT (SELECT *, identified - screened AS duplicates_removed, fulltext_sought - fulltext_not_retrieved AS fulltext_assessed FROM counts) ON COLUMNS(*) INTO NAME item VALUE n) SELECT item, CAST(n AS BIGINT) AS n FROM l"""
)
def prisma_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.flow_rows(_counts(spark, sf_dir)).drop("pos")


@query(
    f"""WITH {COUNTS_SQL}, by_source AS (SELECT string_agg(source_db || ', ' || n, '; ' ORDER BY source_db) AS s FROM (SELECT source AS source_db, count(*) AS n FROM documents GROUP BY 1)),
reasons AS (SELECT string_agg(reason || ', ' || n, '; ' ORDER BY reason) AS s FROM (SELECT reason, count(*) AS n FROM reports GROUP BY 1)),
cells AS (SELECT unnest(['database_results', 'database_specific_results', 'duplicates', 'records_screened', 'records_excluded', 'dbr_sought_reports', 'dbr_notretrieved_reports', 'dbr_assessed', 'dbr_excluded', 'new_studies', 'new_reports', 'total_studies', 'total_reports']) AS data,
  unnest([identified::VARCHAR, (SELECT s FROM by_source), (identified - screened)::VARCHAR, screened::VARCHAR, excluded_ta::VARCHAR, fulltext_sought::VARCHAR, fulltext_not_retrieved::VARCHAR, (fulltext_sought - fulltext_not_retrieved)::VARCHAR, (SELECT s FROM reasons), included::VARCHAR, included::VARCHAR, included::VARCHAR, included::VARCHAR]) AS n FROM counts)
SELECT data, n FROM cells UNION ALL SELECT unnest(['register_results', 'register_specific_results', 'excluded_automatic', 'excluded_other', 'previous_studies', 'previous_reports', 'website_results', 'organisation_results', 'citations_results', 'other_sought_reports', 'other_notretrieved_reports', 'other_assessed', 'other_excluded']), '0'
UNION ALL SELECT unnest(['total_studies_ma', 'total_reports_ma']), '4'"""
)
def flow_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.flow_cells(_counts(spark, sf_dir), meta_k=4)


DOMAINS = ("user", "assistant", "system")


@query(
    """WITH r AS (SELECT conv_id AS study_id, role, arg_max(CASE length(text) % 5 WHEN 0 THEN 'Low' WHEN 1 THEN 'Some concerns' WHEN 2 THEN 'High' ELSE 'No information' END, turn) AS j FROM conversations GROUP BY 1, 2)
SELECT c.study_id AS "Study", coalesce(max(j) FILTER (role = 'user'), 'No information') AS "user", coalesce(max(j) FILTER (role = 'assistant'), 'No information') AS assistant, coalesce(max(j) FILTER (role = 'system'), 'No information') AS system,
  CASE WHEN c.study_id % 4 = 0 THEN 'No information' WHEN c.study_id % 4 = 1 THEN 'High' ELSE 'Low' END AS "Overall" FROM (SELECT DISTINCT conv_id AS study_id FROM conversations) c LEFT JOIN r USING (study_id) GROUP BY c.study_id"""
)
def robvis_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    size = F.length("text") % 5
    domains = turns.select(F.col("conv_id").alias("study_id"), F.col("role").alias("domain"), F.when(size == 0, "low").when(size == 1, "some_concerns").when(size == 2, "high").when(size == 3, "unclear").otherwise("odd").alias("judgment"), F.col("turn").alias("seq"))
    n = F.col("study_id") % 4
    overall = domains.select("study_id").distinct().withColumn("overall", F.when(n == 1, "high").when(n > 1, "low"))
    return exports.robvis(domains, overall, list(DOMAINS))


@query(
    """WITH f AS (SELECT conv_id AS study_id, role AS key, arg_max(CASE WHEN length(text) % 4 = 0 THEN '—' ELSE text END || CASE WHEN turn % 2 = 1 THEN ' ⚠️' ELSE '' END, turn) AS v FROM conversations GROUP BY 1, 2)
SELECT study_id, coalesce(max(v) FILTER (key = 'user'), '—') AS "user", coalesce(max(v) FILTER (key = 'assistant'), '—') AS assistant, coalesce(max(v) FILTER (key = 'system'), '—') AS system FROM f GROUP BY 1"""
)
def extraction_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    fields = turns.select(F.col("conv_id").alias("study_id"), F.col("role").alias("key"), F.when(F.length("text") % 4 == 0, F.lit(None)).otherwise(F.col("text")).alias("value"), F.when(F.col("turn") % 2 == 1, "needs_review").otherwise("found").alias("status"), F.col("turn").alias("seq"))
    return exports.extraction_table(fields, list(DOMAINS))


# --- sources -----------------------------------------------------------------------------------------------------------


@query(
    r"""SELECT doc_id AS seq, coalesce(CASE WHEN doc_id % 2 = 0 THEN '10.9/w' || doc_id END, 'W' || doc_id) AS record_id, CASE WHEN doc_id % 2 = 0 THEN '10.9/w' || doc_id END AS doi, CAST(2000 + doc_id % 20 AS INT) AS year,
  CASE WHEN doc_id % 5 <> 0 THEN 'Hello world Hello ' || lang END AS abstract, CASE WHEN doc_id % 3 = 0 THEN 'https://oa/' || doc_id ELSE 'https://land/' || doc_id END AS oa_url FROM documents"""
)
def works_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, text = F.col("doc_id"), F.col("doc_id").cast("string")
    index = F.when(n % 5 != 0, F.create_map(F.lit("Hello"), F.array(F.lit(0), F.lit(2)), F.lit("world"), F.array(F.lit(1)), F.col("lang"), F.array(F.lit(3)))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<int>>")))
    raw = read(spark, sf_dir, "documents").select(
        n.alias("seq"), F.concat(F.lit("https://openalex.org/W"), text).alias("id"), F.when(n % 2 == 0, F.concat(F.lit("https://doi.org/10.9/W"), text)).alias("doi"), F.col("source").alias("title"), (2000 + n % 20).cast("int").alias("publication_year"),
        index.alias("abstract_inverted_index"), F.array(F.struct(F.struct(F.lit("A").alias("display_name")).alias("author"))).alias("authorships"), F.struct(F.when(n % 3 == 0, F.concat(F.lit("https://oa/"), text)).alias("oa_url")).alias("open_access"),
        F.struct(F.lit(None).cast("string").alias("pdf_url"), F.concat(F.lit("https://land/"), text).alias("landing_page_url")).alias("primary_location"),
    )
    return R.works(raw).select("seq", "record_id", "doi", "year", "abstract", F.try_element_at("extra", F.lit("oa_url")).alias("oa_url"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 50 documents each in RIS form: fields of each are known, so the parser can be held against them."""
    n = F.col("doc_id")
    text = n.cast("string")
    entry = F.concat(F.lit("TY  - JOUR\nT1  - Title "), text, F.when(n % 2 == 0, F.concat(F.lit("\nDO  - https://doi.org/10.7/Q"), text)).otherwise(""), F.lit("\nAU  - First A\nAU  - Second B\nPY  - c"), (1990 + n % 30).cast("string"), F.lit("/x\nnoise\nUR  - u"), text, F.lit("\nER  - \n"))
    return read(spark, sf_dir, "documents").groupBy((n / 50).cast("long").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("entry")))), lambda x: x["entry"]), "\n").alias("text")).select(F.format_string("f%08d", "file").alias("path"), "text")


IMPORT_SQL = r"""SELECT printf('f%08d', CAST(floor(doc_id / 50) AS BIGINT)) AS path, CAST(row_number() OVER (PARTITION BY floor(doc_id / 50) ORDER BY doc_id) - 1 AS BIGINT) AS rec,
  CASE WHEN doc_id % 2 = 0 THEN '10.7/q' || doc_id ELSE 'hash:' || left(sha256('title ' || doc_id), 16) END AS record_id, 'Title ' || doc_id AS title, ['First A', 'Second B'] AS authors, CAST(1990 + doc_id % 30 AS INT) AS year, 'u' || doc_id AS url FROM documents"""


@query(IMPORT_SQL)
def ris_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parse_ris(_tagged(spark, sf_dir)).select("seq.path", F.col("seq.rec").cast("long").alias("rec"), "record_id", "title", "authors", "year", "url")


@query(IMPORT_SQL)
def bibtex_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    text = n.cast("string")
    entry = F.concat(F.lit("@article{k"), text, F.lit(',\n  title = {Title\n   '), text, F.lit('},\n  author = "First A and Second B",\n  year = {'), (1990 + n % 30).cast("string"), F.lit("}, url={u"), text, F.lit("}"), F.when(n % 2 == 0, F.concat(F.lit(", doi = {https://doi.org/10.7/Q"), text, F.lit("}"))).otherwise(""), F.lit("\n}\n"))
    files = read(spark, sf_dir, "documents").groupBy((n / 50).cast("long").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("entry")))), lambda x: x["entry"]), "\n").alias("text"))
    parsed = R.parse_bibtex(files.select(F.format_string("f%08d", "file").alias("path"), "text"))
    return parsed.select("seq.path", F.col("seq.rec").cast("long").alias("rec"), "record_id", "title", "authors", "year", "url")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'openalex' WHEN p_partkey % 4 = 1 THEN 'pubmed' END AS backend, CASE p_partkey % 4 WHEN 0 THEN 'database' WHEN 1 THEN 'database' WHEN 2 THEN 'manual' ELSE 'unknown' END AS kind FROM part")
def backend_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*[F.lit(x) for x in ("Open Alex", "MEDLINE", "Web of Science", "my own list")]), (F.col("p_partkey") % 4).cast("int"))
    return R.backend_of(read(spark, sf_dir, "part").select("p_partkey", name.alias("name")), "name").select("p_partkey", "backend", "kind")


@query("SELECT row_number() OVER (ORDER BY part, id) AS seq, part, id FROM (SELECT 0 AS part, doc_id AS id FROM documents UNION ALL SELECT 1, page_id FROM pages)")
def union_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.lit(0).alias("part"), F.col("doc_id").alias("id"))
    b = read(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.lit(1).alias("part"), F.col("page_id").alias("id"))
    return R.dense_seq(R.in_order([a, b]))


@query("SELECT doc_id AS record_id, CASE WHEN (y1 AND NOT n1) OR (y2 AND NOT n2) THEN 'include' WHEN NOT (n1 AND NOT y1) OR NOT (n2 AND NOT y2) THEN 'unclear' ELSE 'exclude' END AS ensemble_label, 2 AS n_votes FROM (SELECT doc_id, contains(t, 'tion') AS y1, contains(t, 'ung') AS n1, contains(t, 'ment') AS y2, contains(t, 'ch') AS n2 FROM (SELECT doc_id, lower(text || ' ' || text) AS t FROM documents))")
def stub_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.col("text").alias("title"), F.col("text").alias("abstract"))
    members = {"a": providers.keyword_screener("tion", "ung"), "b": providers.keyword_screener("ment", "ch")}
    return providers.screen(docs, members).select("record_id", "ensemble_label", F.col("n_votes").cast("int").alias("n_votes"))


@query(
    """WITH a AS (SELECT doc_id, text AS abstract, CASE WHEN doc_id % 4 = 0 THEN text END AS archive, doc_id % 5 = 0 AS failed, CASE WHEN doc_id % 3 <> 0 THEN 'https://u/' || doc_id END AS url,
  CASE doc_id % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'no_client' ELSE 'ok' END AS status, CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS page FROM documents),
o AS (SELECT *, archive IS NOT NULL OR (status = 'ok' AND length(page) > 0) AS available FROM a)
SELECT doc_id AS record_id, available, CASE WHEN available THEN NULL WHEN failed OR status = 'error' THEN 'error_http' WHEN url IS NULL THEN 'sin_url_oa' WHEN status = 'no_client' THEN 'sin_httpx' ELSE 'texto_vacio' END AS reason,
  CASE WHEN archive IS NOT NULL THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || doc_id || '/' WHEN available THEN url END AS source_url,
  CAST(CASE WHEN available THEN length(coalesce(archive, page)) ELSE 0 END AS INT) AS n_chars, CASE WHEN available THEN sha256(coalesce(archive, page)) END AS text_sha256 FROM o"""
)
def retrieval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    attempts = read(spark, sf_dir, "documents").select(
        n.alias("record_id"), F.col("text").alias("abstract"), F.concat(F.lit("PMC"), n.cast("string")).alias("pmcid"), F.when(n % 4 == 0, F.col("text")).alias("archive_text"), (n % 5 == 0).alias("archive_failed"),
        F.when(n % 3 != 0, F.concat(F.lit("https://u/"), n.cast("string"))).alias("open_url"), F.when(n % 7 == 0, "error").when(n % 7 == 1, "no_client").otherwise("ok").alias("open_status"), F.when(n % 2 == 0, F.col("text")).otherwise("").alias("open_text"),
    )
    return retrieval.outcomes(attempts).drop("text")


@query("SELECT doc_id, sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS hash FROM documents")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return read(spark, sf_dir, "documents").select("doc_id", T.canonical_sha256(entries).alias("hash"))


@query("SELECT conv_id AS study_id, count(*) AS n_fields, count(*) FILTER (role = 'user' AND length(text) > 0) AS n_review FROM (SELECT c.conv_id, f.role, max(c.text) FILTER (c.role = f.role) AS text FROM conversations c, (SELECT unnest(['user', 'assistant', 'system']) AS role) f GROUP BY 1, 2) GROUP BY 1")
def stub_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    studies = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("record_id")).agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("title"), F.lit("").alias("abstract"))
    answer = lambda asked: asked.withColumns({"found": F.col("key") == "user", "value": F.col("title")})
    fields = providers.extract(studies, DOMAINS, answer)
    return fields.groupBy("study_id").agg(F.count(F.lit(1)).alias("n_fields"), F.count_if(F.col("status") == "needs_review").alias("n_review"))


# --- audit -------------------------------------------------------------------------------------------------------------


def _tagged_ids(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _full_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with what a decision declares and what reviews of flagged citations say."""
    e = F.col("seq")
    return _log(spark, sf_dir).withColumns({"n_labels": F.when(F.col("action").isin("approve", "reject"), e % 5), "forced_human": e % 2 == 0, "verdict": F.when(e % 3 != 0, bindings.FALSE_POSITIVE).otherwise("real"), "reason": F.when(e % 4 == 0, " ").otherwise("seen")})


def _asked(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Requests, their artifacts, and the records they list: another artifact for rob, none for the report, other records in both screenings."""
    n = F.col("doc_id")
    docs = read(spark, sf_dir, "documents")
    listed = lambda stage, where: docs.where(where).select(F.lit(stage).alias("stage"), _tagged_ids("t", n % 50).alias("record_id"))
    return {
        "requests": spark.sql("SELECT * FROM VALUES ('screening_ta', 'r0', NULL), ('screening_ft', 'r1', NULL), ('extraction', 'r2', 'a1'), ('rob', 'r0', 'a2'), ('report', 'r1', NULL) AS v(stage, sha256, artifact_sha256)"),
        "artifacts": spark.sql("SELECT * FROM VALUES ('extraction', 'a1'), ('rob', 'changed') AS v(stage, sha256)"),
        "requested": listed("screening_ta", n % 50 != 3).unionAll(listed("screening_ft", n % 2 == 0)),
        "decided": listed("screening_ta", n >= 0).unionAll(listed("screening_ft", (n % 2 == 0) & (n % 14 != 0))),
    }


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(_tagged_ids("t", F.col("doc_id") % 50).alias("place")).distinct()


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal lines of no to three calls."""
    e, u = F.col("event_id"), F.col("user_id")
    stage = F.get(F.array(*[F.lit(s) for s in ("screening_ta", "retrieval", "verification", "screening_ft", "extraction", "rob")]), (u % 6).cast("int"))
    roles = F.slice(F.array(F.lit("first"), F.when(e % 8 == 2, "first").otherwise("second"), F.lit("third")), F.lit(1), (e % 4).cast("int"))
    return read(spark, sf_dir, "events").select(e.alias("line_no"), stage.alias("stage"), F.when(e % 4 != 0, roles).alias("roles"), F.when(e % 5 != 0, e % 3).alias("n_judged"))


def _run(spark: SparkSession, sf_dir: str) -> audit.Run:
    """A run with every table. Some of them contradict the rest, for relations to find: two thirds hold, a third don't."""
    docs, screened, ft = _decisions(spark, sf_dir)
    reports = screening.excluded_reports(ft, docs)
    gold, _ = _gold_and_decisions(spark, sf_dir)
    none = docs.where("false")
    r, e = F.col("record_id"), F.col("seq")
    calls = _calls(spark, sf_dir, F.col("event_id").alias("seq")).withColumn("prompt_sha256", F.col("response_sha256"))
    counts = flow.flow_counts(docs, docs, screened, ft, reports)
    included = ft.where("final_label = 'include'")
    out = screened.select("final_label").unionAll(ft.select("final_label")).agg(F.count_if(F.col("final_label") == "exclude").alias("total_excluded"))
    span = calls.agg(F.min("ts").alias("started"), F.max("ts").alias("finished"))
    models = F.array(*[F.lit(m) for m in ("fake:m0", "fake:m2", "fake:m4", "remote:m1", "remote:m3", "remote:m5")])
    doubled = counts.select(F.ceil(F.col("included") / 5).alias("n_double"), models.alias("models_used"), F.lit(True).alias("all_deterministic"), F.lit("rob2").alias("rob_tool"), F.lit("completed").alias("status"), F.lit(False).alias("forced_human"))
    votes = screened.select("record_id", F.when(r % 10 == 1, "exclude").otherwise(F.col("ensemble_label")).alias("label"), F.explode(F.array(F.lit("m0"), F.when(r % 20 == 9, "m7").otherwise("m1"))).alias("model"))
    retrieval = ft.join(docs.select("record_id", "title"), "record_id").select("record_id", (r % 11 != 0).alias("available"), F.col("title").alias("text"), F.when(r % 6 == 0, "x").otherwise(F.sha2("title", 256)).alias("text_sha256"), F.length("title").alias("n_chars"))
    digest = F.sha2(r.cast("string"), 256)
    return audit.Run(
        spark,
        {
            "counts": counts, "records": docs, "dedup": docs, "duplicates": none, "screened": screened, "fulltext": ft, "gold": gold,
            "reports": reports.withColumn("reason", F.when(r % 9 == 3, "otro").otherwise(F.col("reason"))), "votes": votes, "screeners": spark.sql("SELECT explode(array('m0', 'm1')) AS model"), "metrics": screening.screening_metrics(screened, gold),
            "calls": calls, "call_copies": calls.where("seq % 100 <> 7"), "log": _full_log(spark, sf_dir), "journal": docs.where(r % 2 == 0).select("record_id"), "journal_lines": _lines(spark, sf_dir),
            "journal_metas": calls.where("seq % 3 = 0").select(F.when(e % 60 == 0, "m9").otherwise(F.col("model")).alias("model"), "response_sha256", "ts"), "retrieval": retrieval,
            "cells": flow.flow_cells(counts).withColumn("n", F.when(F.col("data") == "records_screened", "0").otherwise(F.col("n"))),
            "outputs": docs.select("record_id", digest.alias("output_sha256")), "consolidated": ft.select("record_id", F.when(r % 15 == 2, "x").otherwise(digest).alias("output_sha256")),
            "stated": doubled.crossJoin(F.broadcast(out)).crossJoin(F.broadcast(span)), "assessments": included.select(r.alias("study_id"), F.when(r % 12 == 1, "other").otherwise("rob2").alias("tool")), "second_lines": included.where(r % 21 != 0).select("record_id"),
            "spans": read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("label"), F.col("o_orderdate").cast("timestamp").alias("started"), (F.col("o_orderdate").cast("timestamp") - F.make_dt_interval(secs=F.col("o_orderkey") % 4)).alias("finished")),
            "flags": _flags(spark, sf_dir), **_asked(spark, sf_dir),
        },
        thresholds={"recall": 0.2, "kappa": -1.0},
        registration="id",
    )


#: Each table's faults, as the queries of their own return them.
LINES_SQL = """lines AS (SELECT event_id AS line_no, ['screening_ta', 'retrieval', 'verification', 'screening_ft', 'extraction', 'rob'][1 + user_id % 6] AS stage, event_id % 4 AS n, CASE WHEN event_id % 5 <> 0 THEN event_id % 3 END AS judged FROM events),
line_faults AS (SELECT line_no, stage, CASE WHEN stage = 'verification' AND judged IS NULL THEN 'unknown' ELSE 'number of calls' END AS fault FROM lines
  WHERE CASE stage WHEN 'screening_ta' THEN n <> 2 WHEN 'retrieval' THEN n > 0 WHEN 'verification' THEN judged IS NULL OR n NOT IN (0, judged) ELSE n <> 1 END
  UNION ALL SELECT line_no, stage, 'role called twice' FROM lines WHERE stage = 'screening_ta' AND line_no % 8 = 2)"""
BINDING_SQL = """asked(stage, asked, shown, artifact) AS (VALUES ('screening_ta', 'r0', NULL, NULL), ('screening_ft', 'r1', NULL, NULL), ('extraction', 'r2', 'a1', 'a1'), ('rob', 'r0', 'a2', 'changed'), ('report', 'r1', NULL, NULL)),
requested AS (SELECT 'screening_ta' AS stage, 't' || (doc_id % 50) AS record_id FROM documents WHERE doc_id % 50 <> 3 UNION ALL SELECT 'screening_ft', 't' || (doc_id % 50) FROM documents WHERE doc_id % 2 = 0),
decided AS (SELECT 'screening_ta' AS stage, 't' || (doc_id % 50) AS record_id FROM documents UNION ALL SELECT 'screening_ft', 't' || (doc_id % 50) FROM documents WHERE doc_id % 2 = 0 AND doc_id % 14 <> 0),
gates AS (SELECT e.*, asked, shown, artifact FROM eff e JOIN asked USING (stage)),
mine AS (SELECT l.* FROM log l JOIN gates g ON l.stage = g.stage AND l.request_sha256 IS NOT DISTINCT FROM g.request_sha256 AND l.decision_sha256 IS NOT DISTINCT FROM g.decision_sha256 WHERE l.action = 'label'),
binding_faults AS (SELECT stage, 'another request' AS fault, 1 AS n FROM gates WHERE asked <> request_sha256 UNION ALL SELECT stage, 'no decision hash', 1 FROM gates WHERE decision_sha256 IS NULL
  UNION ALL SELECT g.stage, 'marks under another request', count(*) FROM gates g JOIN log l ON l.stage = g.stage AND l.decision_sha256 = g.decision_sha256 WHERE l.action IN ('label', 'flag_review') AND l.request_sha256 <> g.request_sha256 GROUP BY 1
  UNION ALL SELECT stage, 'another number of labels', abs(seq % 5 - k) FROM (SELECT stage, seq, (SELECT count(*) FROM mine m WHERE m.stage = g.stage) AS k FROM gates g) WHERE seq % 5 <> k
  UNION ALL SELECT stage, 'no artifact hash', 1 FROM gates WHERE stage = 'report' UNION ALL SELECT stage, 'another artifact', 1 FROM gates WHERE artifact <> shown
  UNION ALL SELECT stage, 'other records', count(*) FROM (SELECT stage, record_id, sum(k) AS d FROM (SELECT *, 1 AS k FROM requested UNION ALL SELECT *, -1 FROM decided) GROUP BY 1, 2) WHERE d <> 0 AND stage IN (SELECT stage FROM gates) GROUP BY 1
  UNION ALL SELECT stage, 'label outside the request', count(DISTINCT target) FROM mine m WHERE stage LIKE 'screening%' AND NOT EXISTS (SELECT 1 FROM requested q WHERE q.stage = m.stage AND q.record_id = m.target) GROUP BY 1)"""
FINAL_SQL = """last AS (SELECT *, seq % 2 = 0 AS forced FROM eff WHERE stage = 'report'), flags AS (SELECT DISTINCT 't' || (doc_id % 50) AS place FROM documents WHERE doc_id % 7 = 0),
final_faults AS (SELECT 'the run says otherwise who had to decide' AS fault, NULL AS place FROM last WHERE action = 'approve' AND EXISTS (SELECT 1 FROM flags)
  UNION ALL SELECT 'the decision says otherwise who had to decide', NULL FROM last WHERE action = 'approve' AND forced <> EXISTS (SELECT 1 FROM flags)
  UNION ALL SELECT 'completed without an approval', NULL WHERE NOT EXISTS (SELECT 1 FROM last WHERE action = 'approve')
  UNION ALL SELECT 'flagged citation not reviewed', place FROM flags, last WHERE last.action = 'approve' AND place NOT IN (SELECT l.target FROM log l WHERE l.stage = 'report' AND l.action = 'flag_review' AND l.actor = last.actor AND l.seq % 3 <> 0 AND l.seq % 4 <> 0
    AND l.request_sha256 IS NOT DISTINCT FROM last.request_sha256 AND l.decision_sha256 IS NOT DISTINCT FROM last.decision_sha256))"""


#: Each relation by a way of its own: correlations for the coefficients, whole lists for orders.
RELATIONS_SQL = f"""WITH {COUNTS_SQL}, {LOG_SQL}, {LINES_SQL}, {BINDING_SQL}, {FINAL_SQL},
twice AS (SELECT record_id FROM (SELECT record_id, row_number() OVER (ORDER BY seq) - 1 AS p, count(*) OVER () AS n, greatest(1, ceil(0.2 * count(*) OVER ())) AS k FROM fulltext WHERE final_label = 'include') WHERE p IN (SELECT CAST(trunc(i * (n2::DOUBLE / k2)) AS BIGINT) FROM (SELECT count(*) AS n2, CAST(greatest(1, ceil(0.2 * count(*))) AS BIGINT) AS k2 FROM fulltext WHERE final_label = 'include'), range(0, k2) r(i))),
c AS (SELECT *, fulltext_sought - fulltext_not_retrieved AS assessed FROM counts),
declared AS (SELECT record_id, CASE WHEN record_id % 9 = 3 THEN 'otro' ELSE reason END AS reason FROM reports),
votes AS (SELECT record_id AS voted, CASE WHEN record_id % 10 = 1 THEN 'exclude' ELSE ensemble_label END AS label FROM screened),
g AS (SELECT (ensemble_label IN ('include', 'unclear'))::INT AS p, (quality = 1)::INT AS g FROM labels JOIN screened ON record_id = doc_id),
m AS (SELECT sum(p * g)::DOUBLE AS tp, sum(p * (1 - g))::DOUBLE AS fp, sum((1 - p) * g)::DOUBLE AS fn, sum((1 - p) * (1 - g))::DOUBLE AS tn, count(*) AS n FROM g),
closers AS (SELECT stage, decision_sha256, min(seq) AS closed, bool_or(action = 'reject') AS rejected FROM log WHERE action IN ('approve', 'reject') GROUP BY 1, 2)
SELECT '1' AS family, 'sum of identified_by_source = identified' AS name, identified = (SELECT sum(n) FROM (SELECT count(*) AS n FROM documents GROUP BY source)) AS ok FROM c
UNION ALL SELECT '1', 'identified = records', identified = (SELECT count(*) FROM documents) FROM c
UNION ALL SELECT '1', 'identified_by_source = records by source', NOT EXISTS (SELECT source_db, count(*) FROM records GROUP BY 1 EXCEPT SELECT source, count(*) FROM documents GROUP BY 1)
UNION ALL SELECT '4', 'screened = identified - duplicates', c.screened = identified - (SELECT count(*) - count(DISTINCT doc_id) FROM documents) FROM c
UNION ALL SELECT '4', 'duplicates_removed = duplicates', identified - c.screened = (SELECT count(*) - count(DISTINCT doc_id) FROM documents) FROM c
UNION ALL SELECT '4', 'screened = unique records', c.screened = (SELECT count(DISTINCT doc_id) FROM documents) FROM c
UNION ALL SELECT '4', 'unique ids', (SELECT count(*) = count(DISTINCT doc_id) FROM documents)
UNION ALL SELECT '5', 'decisions = screened', c.screened = (SELECT count(*) FROM screened) FROM c
UNION ALL SELECT '5', 'ensemble label follows the votes', NOT EXISTS (SELECT 1 FROM screened JOIN votes ON voted = record_id WHERE label <> ensemble_label)
UNION ALL SELECT '5', 'final label = human label, else ensemble label', NOT EXISTS (SELECT 1 FROM screened WHERE final_label <> ensemble_label AND final_label IS DISTINCT FROM human_label)
UNION ALL SELECT '5', 'decisions in the order of unique records', (SELECT list(record_id ORDER BY seq) FROM screened) = (SELECT list(doc_id ORDER BY doc_id) FROM documents)
UNION ALL SELECT '6', 'human + ai = excluded_ta', excluded_ta_human + excluded_ta_ai = excluded_ta FROM c
UNION ALL SELECT '6', 'sought = screened - excluded_ta', fulltext_sought = c.screened - excluded_ta FROM c
UNION ALL SELECT '6', 'excluded_ta = excluded decisions', excluded_ta = (SELECT count(*) FROM screened WHERE final_label = 'exclude') FROM c
UNION ALL SELECT '6', 'sought = passing decisions', fulltext_sought = (SELECT count(*) FROM screened WHERE final_label IN ('include', 'unclear')) FROM c
UNION ALL SELECT '7', 'full-text ids = passing ids in order', (SELECT list(record_id ORDER BY seq) FROM fulltext) = (SELECT list(record_id ORDER BY seq) FROM screened WHERE final_label <> 'exclude')
UNION ALL SELECT '7', 'no final label is unclear', NOT EXISTS (SELECT 1 FROM fulltext WHERE final_label = 'unclear')
UNION ALL SELECT '8', 'not retrieved', fulltext_not_retrieved = (SELECT count(*) FROM fulltext WHERE fulltext_status <> 'retrieved' AND human_label IS NULL) FROM c
UNION ALL SELECT '8', 'rescued', fulltext_rescued = (SELECT count(human_label) FROM fulltext WHERE fulltext_status <> 'retrieved') FROM c
UNION ALL SELECT '8', 'assessed = sought - not retrieved', assessed = (SELECT count(*) FROM fulltext WHERE fulltext_status = 'retrieved' OR human_label IS NOT NULL) FROM c
UNION ALL SELECT '9', 'excluded_ft = reports', excluded_ft = (SELECT count(*) FROM declared) FROM c
UNION ALL SELECT '9', 'human + ai = excluded_ft', excluded_ft_human + excluded_ft_ai = excluded_ft FROM c
UNION ALL SELECT '9', 'sum of reasons = excluded_ft', excluded_ft = (SELECT sum(n) FROM (SELECT count(*) AS n FROM reports GROUP BY reason)) FROM c
UNION ALL SELECT '9', 'reports follow the decisions', NOT EXISTS (SELECT 1 FROM reports r JOIN declared d USING (record_id) WHERE r.reason <> d.reason)
UNION ALL SELECT '9.3', 'matrix from decisions and gold', tp + fp + fn + tn = n FROM m
UNION ALL SELECT '9.3', 'recall recomputed', abs(tp / (tp + fn) - (SELECT avg(p) FROM g WHERE g = 1)) < 1e-9 FROM m
UNION ALL SELECT '9.3', 'lost_evidence recomputed', abs(fn / (tp + fn) - (SELECT avg(1 - p) FROM g WHERE g = 1)) < 1e-9 FROM m
UNION ALL SELECT '9.3', 'mcc recomputed', abs((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) - (SELECT corr(p, g) FROM g)) < 1e-9 FROM m
UNION ALL SELECT '9.3', 'wmcc recomputed', abs((tp * tn - fp * fn * 10) / sqrt((tp + fp) * (tp + fn * 10) * (tn + fp) * (tn + fn * 10)) - (SELECT corr(p, g) FROM g, unnest(range(CASE WHEN p < g THEN 10 ELSE 1 END)))) < 1e-9 FROM m
UNION ALL SELECT '9.3', 'kappa recomputed', abs(((tp + tn) / n - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)) / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)) - 2 * (tp * tn - fn * fp) / ((tp + fp) * (fp + tn) + (tp + fn) * (fn + tn))) < 1e-9 FROM m
UNION ALL SELECT '10', 'included = assessed - excluded_ft', included = assessed - excluded_ft FROM c
UNION ALL SELECT '10', 'included = including decisions', included = (SELECT count(*) FROM fulltext WHERE final_label = 'include') FROM c
UNION ALL SELECT '16', 'labels before approval, none with a rejection, no repeats', NOT EXISTS (SELECT 1 FROM log l JOIN closers k ON k.stage = l.stage AND k.decision_sha256 = l.decision_sha256 WHERE l.action IN ('label', 'flag_review') AND (l.seq > closed OR rejected))
  AND NOT EXISTS (SELECT 1 FROM log GROUP BY stage, action, target, request_sha256, decision_sha256 HAVING count(*) > 1)
UNION ALL SELECT '4', 'journal ids among unique records', NOT EXISTS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT record_id FROM screened)
UNION ALL SELECT '7', 'retrieved if and only if available', NOT EXISTS (SELECT 1 FROM fulltext WHERE (fulltext_status = 'retrieved') <> (record_id % 11 > 0))
UNION ALL SELECT '7', 'kept texts match hash and length', NOT EXISTS (SELECT 1 FROM fulltext WHERE record_id % 6 = 0 AND record_id % 11 > 0 AND text IS NOT NULL)
UNION ALL SELECT '11', 'exchange cells = counts', c.screened = 0 FROM c
UNION ALL SELECT '12', 'journalled calls are in the call log', NOT EXISTS (SELECT 1 FROM events WHERE event_id % 60 = 0)
UNION ALL SELECT '13', 'consolidated rows come from the journal', NOT EXISTS (SELECT 1 FROM fulltext WHERE record_id % 15 = 2)
UNION ALL SELECT '10', 'assessments = included', included = (SELECT count(DISTINCT record_id) FROM fulltext WHERE final_label = 'include') FROM c
UNION ALL SELECT '9.3', 'one vote of each screener', NOT EXISTS (SELECT 1 FROM documents WHERE doc_id % 20 = 9)
UNION ALL SELECT '9.3', 'models stated = models called', (SELECT count(DISTINCT user_id % 6) = 6 FROM events)
UNION ALL SELECT '9.3', 'stated as deterministic = all calls are', NOT EXISTS (SELECT 1 FROM events WHERE user_id % 2 = 1)
UNION ALL SELECT '9.3', 'copied calls = calls in order', NOT EXISTS (SELECT 1 FROM events WHERE event_id % 100 = 7)
UNION ALL SELECT '9.3', 'no fewer calls than the decisions took', (SELECT count(*) FROM events) >= 2 * c.screened + assessed - fulltext_rescued + 2 * included + ceil(included / 5.0) + 1 FROM c
UNION ALL SELECT '9.3', 'studies extracted twice = the sample', ceil(included / 5.0) = (SELECT count(*) FROM twice) FROM c
UNION ALL SELECT '13', 'each study of the sample in the second journal', NOT EXISTS (SELECT 1 FROM twice WHERE record_id % 21 = 0)
UNION ALL SELECT '9.3', 'assessed with the tool stated', NOT EXISTS (SELECT 1 FROM fulltext WHERE final_label = 'include' AND record_id % 12 = 1)
UNION ALL SELECT '10', 'total_excluded = excluded_ta + excluded_ft', (SELECT count(*) FROM (SELECT final_label AS f FROM screened UNION ALL SELECT final_label FROM fulltext) WHERE f = 'exclude') = excluded_ta + excluded_ft FROM c
UNION ALL SELECT '12', 'calls of each journal line', CASE WHEN count(*) FILTER (fault <> 'unknown') > 0 THEN false WHEN count(*) = 0 THEN true END FROM line_faults
UNION ALL SELECT '14', 'calls within the run', true
UNION ALL SELECT '14', 'log within the run', (SELECT min(ts) FROM log) >= (SELECT min(ts) - INTERVAL 2 SECONDS FROM events)
UNION ALL SELECT '14', 'spans end after their start', NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 4 = 3)
UNION ALL SELECT '15', 'decisions are of what was asked', NOT EXISTS (SELECT 1 FROM binding_faults)
UNION ALL SELECT '17', 'a person decided on flagged citations', NOT EXISTS (SELECT 1 FROM final_faults WHERE fault NOT LIKE 'completed%')
UNION ALL SELECT '18', 'completed only with an approval', NOT EXISTS (SELECT 1 FROM final_faults WHERE fault LIKE 'completed%')"""


@query(f"WITH {LINES_SQL} SELECT stage, fault, count(*) AS n FROM line_faults GROUP BY 1, 2")
def journal_line_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.line_faults(_lines(spark, sf_dir), 2, None).groupBy("stage", "fault").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG_SQL}, s AS (SELECT min(ts) AS a, max(ts) AS b FROM events) SELECT seq AS label, ts, CASE WHEN ts < a THEN 'before the start' ELSE 'after the end' END AS fault FROM log, s WHERE ts < a - INTERVAL 2 SECONDS OR ts > b - INTERVAL 1 HOUR + INTERVAL 2 SECONDS")
def mark_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries outside of a run that ended an hour before the last event."""
    span = read(spark, sf_dir, "events").agg(F.min("ts").alias("started"), (F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("finished"))
    return bindings.mark_faults(_log(spark, sf_dir).withColumn("label", F.col("seq")), span)


@query(f"WITH {LOG_SQL}, {BINDING_SQL} SELECT stage, fault, CAST(n AS BIGINT) AS n FROM binding_faults")
def binding_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.binding_faults(_full_log(spark, sf_dir), **_asked(spark, sf_dir))


@query(f"WITH {LOG_SQL.replace('FROM events)', 'FROM events WHERE event_type <> ' + repr('signup') + ')')}, {FINAL_SQL} SELECT fault, place FROM final_faults")
def final_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a log without rejections, so that the report is approved."""
    stated = spark.sql("SELECT 'completed' AS status, false AS forced_human")
    return bindings.final_faults(_full_log(spark, sf_dir).where("action <> 'reject'"), stated, _flags(spark, sf_dir))


@query(RELATIONS_SQL)
def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.relations(_run(spark, sf_dir)).select("family", "name", "ok")


@query(
    f"""WITH {LOG_SQL}, places AS (SELECT * FROM (VALUES ('screening_ta', 1), ('screening_ft', 2), ('extraction', 3), ('rob', 4), ('report', 5)) p(stage, place)), acted AS (SELECT *, CASE WHEN user_id_of % 9 = 4 THEN 'auto-approve (demo)' WHEN user_id_of % 9 = 5 THEN 'human: ' ELSE actor END AS who FROM (SELECT *, CAST(substr(actor, 8) AS INT) AS user_id_of FROM log WHERE stage <> 'extraction')),
last AS (SELECT stage, arg_max(who, seq) AS who FROM acted WHERE action IN ('approve', 'reject', 'auto-proceed') GROUP BY 1)
SELECT stage, CASE WHEN who IS NULL THEN 'missing' WHEN who LIKE 'human:u%' THEN 'no request' ELSE 'not human' END AS fault FROM places LEFT JOIN last USING (stage) WHERE place < 5 AND CASE WHEN who IS NULL THEN stage = 'screening_ta' OR place < (SELECT max(place) FROM last JOIN places USING (stage)) ELSE stage = 'screening_ft' OR who NOT LIKE 'human:u%' END
UNION ALL SELECT DISTINCT stage, 'automatic' FROM acted WHERE who LIKE 'auto%' AND action IN ('approve', 'reject', 'auto-proceed')"""
)
def gate_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nobody decides on extractions, a third of the actors are no people, and full texts were never asked for."""
    number = F.substring("actor", 8, 2).cast("int") % 9
    log = _log(spark, sf_dir).where("stage <> 'extraction'").withColumn("actor", F.when(number == 4, ledger.AUTO_APPROVER).when(number == 5, "human: ").otherwise(F.col("actor")))
    requests = log.where("stage <> 'screening_ft'").select("stage").distinct()
    return ledger.gate_faults(log, ("screening_ta",), requests)


def _searches(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A search log of a row a supplier, its failures, strings and the databases declared."""
    k = F.col("s_suppkey")
    tag = lambda prefix: F.concat(F.lit(prefix), k.cast("string"))
    suppliers = read(spark, sf_dir, "supplier")
    status = F.get(F.array(*[F.lit(s) for s in ("failed", "manual_only", "unknown", "ok", "ok", "ok")]), (k % 6).cast("int"))
    log = suppliers.select(
        tag("Base ").alias("database"), F.when(k % 11 == 0, "other").otherwise(tag("base")).alias("db_key"), F.when(k % 5 == 4, "manual_import").when(k % 5 == 3, "injected").otherwise("database").alias("kind"), status.alias("status"),
        F.when(k % 13 == 0, -1).otherwise(k % 4).alias("n_returned"), F.lit(3).alias("max_results"), F.when(k % 12 != 0, "e").alias("error"), F.when((k % 6 != 0) | (k % 18 == 0), F.array(F.concat(F.lit("src"), (k % 2).cast("string")))).alias("source_db"),
        F.when(k % 7 != 0, tag("q")).alias("query"), F.when(k % 9 == 0, "bad").otherwise(F.sha2(tag("q"), 256)).alias("query_sha256"), F.when(k % 8 == 0, None).when(k % 8 < 4, "file").when(k % 8 == 4, "question_fallback").otherwise("inline").alias("query_origin"),
        F.when((k % 8).isin(1, 2, 5), tag("f")).alias("query_file"), F.when(k % 10 != 4, "h").alias("file_sha256"),
    )
    failures = log.where("status = 'failed'").select("database").join(suppliers.where("s_suppkey % 30 = 0").select(tag("Base ").alias("database")), "database", "left_anti").unionAll(spark.sql("SELECT 'Ghost'"))
    strings = suppliers.select(tag("f").alias("query_file"), F.when(k % 16 == 1, "x").otherwise(F.concat(F.lit(" "), tag("q"), F.lit("\n"))).alias("text"))
    declared = spark.sql("SELECT 'Base 1' AS database UNION ALL SELECT 'Not There'")
    return {"search_log": log, "failures": failures, "search_strings": strings, "databases": declared}


@query(
    """WITH e AS (SELECT s_suppkey AS k, 'Base ' || k AS database, CASE WHEN k % 5 = 4 THEN 'manual_import' WHEN k % 5 = 3 THEN 'injected' ELSE 'database' END AS kind, CASE k % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'manual_only' WHEN 2 THEN 'unknown' ELSE 'ok' END AS status,
  CASE WHEN k % 13 = 0 THEN -1 ELSE k % 4 END AS n, k % 7 = 0 AS no_query, CASE WHEN k % 8 = 0 THEN NULL WHEN k % 8 < 4 THEN 'file' WHEN k % 8 = 4 THEN 'question_fallback' ELSE 'inline' END AS origin, k % 8 IN (1, 2, 5) AS has_file FROM supplier),
one AS (SELECT sum(n) FILTER (status = 'ok') AS returned, sum(n) FILTER (status = 'ok' AND kind = 'manual_import') AS imported FROM e)
SELECT database, 'FAIL' AS level, 'negative count' AS fault FROM e WHERE n < 0
UNION ALL SELECT database, 'FAIL', 'key of another database' FROM e WHERE kind = 'database' AND k % 11 = 0
UNION ALL SELECT database, 'FAIL', 'unknown status' FROM e WHERE k % 6 = 2
UNION ALL SELECT database, 'WARN', 'failed' FROM e WHERE k % 6 = 0
UNION ALL SELECT database, 'FAIL', 'failed without an error or with records' FROM e WHERE k % 6 = 0 AND (k % 12 = 0 OR n <> 0 OR k % 18 = 0)
UNION ALL SELECT database, 'FAIL', 'failure not recorded' FROM e WHERE k % 6 = 0 AND k % 30 = 0
UNION ALL SELECT database, 'WARN', 'manual search without imports' FROM e, one WHERE k % 6 = 1 AND coalesce(imported, 0) = 0
UNION ALL SELECT database, 'WARN', 'manual search without its query' FROM e WHERE k % 6 = 1 AND no_query
UNION ALL SELECT database, 'WARN', 'the question served as query' FROM e WHERE k % 8 = 4
UNION ALL SELECT database, 'WARN', 'as many results as asked for' FROM e WHERE status = 'ok' AND n = 3
UNION ALL SELECT database, 'FAIL', 'no query or origin' FROM e WHERE status = 'ok' AND ((kind = 'database' AND (no_query OR k % 8 = 0)) OR (kind = 'injected' AND no_query))
UNION ALL SELECT database, 'FAIL', 'hash of another query' FROM e WHERE NOT no_query AND k % 9 = 0
UNION ALL SELECT database, 'FAIL', 'origin and file disagree' FROM e WHERE k % 8 IN (3, 5)
UNION ALL SELECT database, 'FAIL', 'file holds another query' FROM e WHERE k % 8 IN (1, 2) AND (k % 16 = 1 OR no_query)
UNION ALL SELECT database, 'FAIL', 'import without a hash' FROM e WHERE kind = 'manual_import' AND status = 'ok' AND k % 10 = 4
UNION ALL SELECT NULL, 'WARN', 'injected search' WHERE EXISTS (SELECT 1 FROM e WHERE kind = 'injected')
UNION ALL SELECT NULL, 'FAIL', 'counts and records disagree' FROM one WHERE coalesce(returned, 0) <> (SELECT count(*) FROM documents)
UNION ALL SELECT NULL, 'FAIL', 'sources of log and records disagree' WHERE EXISTS (SELECT 1 FROM documents WHERE source IS NULL OR source NOT IN ('src0', 'src1')) OR NOT EXISTS (SELECT 1 FROM documents WHERE source = 'src0') OR NOT EXISTS (SELECT 1 FROM documents WHERE source = 'src1')
UNION ALL VALUES ('Ghost', 'FAIL', 'failure without an entry'), ('Not There', 'FAIL', 'declared but not searched')"""
)
def search_log_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _searches(spark, sf_dir)
    records = read(spark, sf_dir, "documents").select(F.col("source").alias("source_db"))
    return searchlog.entry_faults(t["search_log"], t["failures"], t["search_strings"]).unionByName(searchlog.log_faults(t["search_log"], records, t["failures"], t["databases"]))


def _audited(spark: SparkSession, sf_dir: str) -> audit.Run:
    """The run with its files and logs: a hash, a file and a deliverable are wrong, some lines and citations are bad."""
    run = _run(spark, sf_dir)
    k, n = F.col("n_nationkey"), F.col("doc_id")
    files = read(spark, sf_dir, "nation").select(_tagged_ids("f", k).alias("file"), F.get(F.array(*[F.lit(s) for s in ledger.STAGES]), (k % 5).cast("int")).alias("stage"), F.sha2(k.cast("string"), 256).alias("sha256"), (k % 3).alias("n_bytes"), k)
    more = {
        "manifest": read(spark, sf_dir, "nation").where(k == 0).select(F.lit(audit.PROVENANCE).alias("provenance")), "lines": read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 97 == 5, "bad").otherwise("ok").alias("status")),
        "declared_hashes": files.select("file", "sha256"), "actual_hashes": files.select("file", F.when(k == 7, "edited").otherwise(F.col("sha256")).alias("sha256")), "required": files.select("stage", "file"), "present": files.where(k != 24).select("file", "n_bytes"),
        "citation_checks": read(spark, sf_dir, "documents").select((n % 19 != 0).alias("exists_in_corpus"), F.lit(True).alias("grounded")), "window": spark.sql("SELECT '2024-01-02' AS declared"),
    }
    searches = _searches(spark, sf_dir)
    searches["search_log"] = searches["search_log"].withColumn("started_utc", F.concat(F.lit("2024-01-0"), (1 + F.length("database") % 2).cast("string"), F.lit("T00:00:00+00:00")))
    return replace(run, tables=run.tables | more | searches, deliverables=("f1", "f3"))


@query(
    f"""WITH {DECISIONS_SQL}, {LOG_SQL}, {BINDING_SQL}, {CALLS_SQL}, closers AS (SELECT stage, decision_sha256, min(seq) AS closed, bool_or(action = 'reject') AS rejected FROM log WHERE action IN ('approve', 'reject') GROUP BY 1, 2),
g AS (SELECT (ensemble_label IN ('include', 'unclear'))::INT AS p, (quality = 1)::INT AS g FROM labels JOIN screened ON record_id = doc_id),
firsts AS (SELECT min(seq) AS f, list_position(['screening_ta', 'screening_ft', 'extraction', 'rob', 'report'], stage) AS i FROM log WHERE action IN ('approve', 'reject') GROUP BY stage),
found AS (SELECT 'manifest' AS check_id, bool_or(provider = 'fake') AS bad, 'WARN' AS as_ FROM calls
UNION ALL SELECT 'provenance', false, 'FAIL' UNION ALL SELECT 'prompts', false, 'FAIL' UNION ALL SELECT 'registration', false, 'WARN'
UNION ALL SELECT 'schemas', EXISTS (SELECT 1 FROM events WHERE event_id % 97 = 5), 'FAIL'
UNION ALL SELECT 'protocol_snapshot', EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 7), 'FAIL'
UNION ALL SELECT 'timing', EXISTS (SELECT 1 FROM (SELECT ts, max(ts) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM log) WHERE before - ts > INTERVAL 2 SECONDS), 'FAIL'
UNION ALL SELECT 'ledger', EXISTS (SELECT 1 FROM firsts a JOIN firsts b ON a.i < b.i AND a.f > b.f) OR EXISTS (SELECT 1 FROM log l JOIN closers k ON k.stage = l.stage AND k.decision_sha256 = l.decision_sha256 WHERE l.action IN ('label', 'flag_review') AND (l.seq > closed OR rejected))
  OR EXISTS (SELECT 1 FROM log GROUP BY stage, action, target, request_sha256, decision_sha256 HAVING count(*) > 1), 'FAIL'
UNION ALL SELECT 'hitl', EXISTS (SELECT 1 FROM screened WHERE human_label IS NOT NULL) OR EXISTS (SELECT 1 FROM mine WHERE stage = 'screening_ta') OR (SELECT count(DISTINCT stage) < 4 FROM eff WHERE stage <> 'report'), 'FAIL'
UNION ALL SELECT 'request_hash', EXISTS (SELECT 1 FROM gates WHERE asked IS DISTINCT FROM request_sha256), 'FAIL'
UNION ALL SELECT 'final_gate', NOT EXISTS (SELECT 1 FROM eff WHERE stage = 'report' AND action = 'approve'), 'FAIL'
UNION ALL SELECT 'stage_artifacts', EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 24), 'FAIL'
UNION ALL SELECT 'exclusions', (SELECT count(*) FROM screened WHERE final_label = 'exclude') <> (SELECT count(*) FROM screened WHERE human_label = 'exclude' OR (ensemble_label = 'exclude' AND human_label IS NULL)), 'FAIL'
UNION ALL SELECT 'deliverable', (SELECT count(*) < 2 FROM nation WHERE n_nationkey IN (1, 3) AND n_nationkey % 3 > 0), 'FAIL'
UNION ALL SELECT 'gold', corr(p, g) IS NULL, 'WARN' FROM g
UNION ALL SELECT 'grounding', EXISTS (SELECT 1 FROM documents WHERE doc_id % 19 = 0), 'FAIL'
UNION ALL SELECT 'search_log', EXISTS (SELECT 1 FROM ({ORACLES["search_log_faults"]}) WHERE level = 'FAIL'), 'FAIL'
UNION ALL SELECT 'search_window', false, 'WARN'
UNION ALL SELECT 'response_overlap', EXISTS (SELECT 1 FROM ({ORACLES["response_overlap"]}) WHERE suspicious), 'WARN')
SELECT check_id, CASE WHEN bad THEN as_ ELSE 'PASS' END AS status FROM found
UNION ALL SELECT 'thresholds', CASE WHEN coalesce(avg(p), 0) < 0.2 THEN 'FAIL' WHEN count(*) < 2 THEN 'WARN' ELSE 'PASS' END FROM g WHERE g = 1
UNION ALL SELECT 'arithmetic', CASE WHEN count(*) FILTER (NOT ok) > 0 THEN 'FAIL' WHEN count(*) > count(ok) THEN 'WARN' ELSE 'PASS' END FROM ({RELATIONS_SQL})"""
)
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.checks(_audited(spark, sf_dir)).select("check_id", "status")


# --- journal -----------------------------------------------------------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("record_id"), F.col("event_type").alias("input"), F.col("event_id").alias("seq"))
    return journal.keyed(rows, F.col("input"))


@query("SELECT count(*) AS n_pending FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 0 EXCEPT SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 <> 0)")
def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _requests(spark, sf_dir)
    known = requests.where("seq % 3 <> 0").withColumn("output", F.col("input"))
    return journal.run_batch(requests.where("seq % 3 = 0"), known, lambda df: df.withColumn("output", F.upper("input"))).agg(F.count(F.lit(1)).alias("n_pending"))


@query("SELECT 'u' || user_id AS record_id, count(DISTINCT value) AS n_outputs FROM (SELECT user_id, event_type, CASE WHEN event_id % 50 = 0 THEN 'other' ELSE 'same' END AS value FROM events) GROUP BY user_id, event_type HAVING count(DISTINCT value) > 1")
def journal_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _requests(spark, sf_dir).withColumn("output", F.when(F.col("seq") % 50 == 0, "other").otherwise("same"))
    return journal.conflicts(rows).select("record_id", "n_outputs")


@query("SELECT model, CASE WHEN m < 2 THEN DATE '2026-06-01' WHEN m = 2 THEN DATE '2025-12-02' END AS shutdown, m < 3 AS is_past FROM (SELECT DISTINCT p_partkey % 4 AS m, CASE p_partkey % 4 WHEN 0 THEN 'google/m-2.0' WHEN 1 THEN 'M-2.0:free' WHEN 2 THEN 'm-2.5-pre' ELSE 'other' END AS model FROM part)")
def retired_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.get(F.array(*[F.lit(x) for x in ("google/m-2.0", "M-2.0:free", "m-2.5-pre", "other")]), (F.col("p_partkey") % 4).cast("int"))
    models = read(spark, sf_dir, "part").select(model.alias("model")).distinct()
    table = spark.sql("SELECT * FROM VALUES ('m-2.0', DATE '2026-06-01'), ('m-2.5-pre', DATE '2025-12-02') AS t(name, shutdown)")
    return audit.retirements(models, table, F.lit("2026-07-01").cast("date"))


# --- nested values -----------------------------------------------------------------------------------------------------


def _summary(n: str, ratio: str, tags: str, extra: str = "", p: str = "") -> str:
    """SQL of a document's nested summary as JSON text; both engines build it from strings alike."""
    return f"""concat('{{"n":', {n}, ',"ratio":', {ratio}, ',"tags":[', {tags}, '],"deep":{{"list":[{{"k":1}},{{"k":', doc_id, '}}],"p_value":', {p or "doc_id"}, '}}'{extra}, '}}')"""


#: Three planted differences, a number within the tolerance, a whole number for a float, and an ignored key that differs.
DECLARED = _summary(
    "CASE WHEN doc_id % 50 = 1 THEN n_chars + 1 ELSE n_chars END",
    "CASE doc_id % 50 WHEN 4 THEN concat(n_chars, '.50000000001') WHEN 5 THEN concat(n_chars, '.6') WHEN 6 THEN concat(n_chars) ELSE concat(n_chars, '.5') END",
    """CASE WHEN doc_id % 50 = 2 THEN '"x"' ELSE '"x","y"' END""",
    """, CASE WHEN doc_id % 50 = 3 THEN ',"new key":{"a":null}' ELSE '' END""",
    "doc_id + 7",
)
RECOMPUTED = _summary("n_chars", "concat(n_chars, '.5')", """'"x","y"'""")


@query(
    """SELECT doc_id, CASE doc_id % 50 WHEN 1 THEN '.n' WHEN 2 THEN '.tags' WHEN 3 THEN '["new key"]' ELSE '.ratio' END AS path, CASE doc_id % 50 WHEN 1 THEN 'value' WHEN 2 THEN 'length' WHEN 3 THEN 'extra' ELSE 'value' END AS problem,
  CASE doc_id % 50 WHEN 1 THEN concat(n_chars) WHEN 2 THEN 'array' WHEN 3 THEN NULL ELSE concat(n_chars, '.5') END AS expected,
  CASE doc_id % 50 WHEN 1 THEN concat(n_chars + 1) WHEN 2 THEN 'array' WHEN 3 THEN 'object' WHEN 5 THEN concat(n_chars, '.6') ELSE concat(n_chars) END AS actual
FROM documents WHERE doc_id % 50 IN (1, 2, 3, 5) OR (doc_id % 50 = 6 AND n_chars < 500000000)"""
)
def nested_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    declared, recomputed = (docs.select("doc_id", F.parse_json(F.expr(sql)).alias("summary")) for sql in (DECLARED, RECOMPUTED))
    return nested.differences(declared, recomputed, "doc_id", "summary", ignored=("p_value",))


@query(
    """SELECT doc_id, sha256(concat('{"z":[', doc_id, ',null,{"', coalesce(lang, ''), '":', n_chars, '.25,"é \U0001f600":"', coalesce(source, ''), '"}]}')) AS text_sha256,
  sha256(concat('{"about":{"lang":"', lang, '","none":null},"counts":{"chars":', n_chars, ',"id":', doc_id, '},"halves":[', n_chars, '.5,null]}')) AS typed_sha256 FROM documents"""
)
def canonical_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = F.format_string('{ "z" : [%s, null,\n {"é \U0001f600":"%s", "%s": %s.250}]}', "doc_id", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), "n_chars")
    typed = F.struct(F.array(F.col("n_chars") + F.lit(0.5), F.lit(None).cast("double")).alias("halves"), F.create_map(F.lit("id"), "doc_id", F.lit("chars"), "n_chars").alias("counts"), F.struct(F.lit(None).cast("string").alias("none"), "lang").alias("about"))
    rows = docs.select("doc_id", text.alias("text"), typed.alias("typed"))
    found = nested.canonical_json(nested.canonical_json(rows, "text", "a"), "typed", "b")
    return found.select("doc_id", F.col("a.sha256").alias("text_sha256"), F.col("b.sha256").alias("typed_sha256"))
