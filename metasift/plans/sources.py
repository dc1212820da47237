"""Registered queries of the source mappers and the journal's stream, each with its SQL.

Every answer is made of documents, so that each field of a record is known; the SQL states the record itself.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metasift.operators import budget, ledger
from metasift.operators.ordered import shared_folder
from metasift.plans.queries import query, read
from metasift.sources import articles, frozen, validated
from metasift.sources import records as R
from metasift.streaming import gates, index, journal

#: The text without tags and without white space at its ends.
BARE = r"nullif(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g'), '')"
TITLE = "coalesce(nullif(source, ''), '(sin título)')"


def _ids() -> tuple[Column, Column]:
    """A document's id as a number and as text."""
    return F.col("doc_id"), F.col("doc_id").cast("string")


def _joined(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _every(k: int, value: str | Column, rest: int = 0) -> Column:
    """``value`` where the id leaves ``rest`` when divided by ``k``, else null."""
    return F.when(F.col("doc_id") % k == rest, F.lit(value) if isinstance(value, str) else value)


def _raw(spark: SparkSession, sf_dir: str, **fields: Column) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), *[c.alias(name) for name, c in fields.items()])


def _shown(records: DataFrame, *extras: str) -> DataFrame:
    """Records with some of their extras as columns in place of the map."""
    return records.withColumns({e: F.try_element_at("extra", F.lit(e)) for e in extras}).drop("extra") if extras else records.drop("extra")


@query(
    f"""SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN 'crossref:' || doc_id ELSE '10.5/c' || doc_id END AS record_id, CASE WHEN doc_id % 4 = 0 THEN '(sin título)' ELSE {TITLE} END AS title, {BARE} AS abstract,
  [CASE WHEN doc_id % 2 = 0 THEN 'Ada L' ELSE 'L' END || doc_id] AS authors, CASE WHEN doc_id % 5 <> 0 THEN CAST(2000 + doc_id % 20 AS INT) END AS year, CASE WHEN doc_id % 3 <> 0 THEN '10.5/c' || doc_id END AS doi, 'https://x/' || doc_id AS url, 'Crossref' AS source_db FROM documents"""
)
def crossref_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, tag = _ids()
    raw = _raw(
        spark, sf_dir, DOI=F.when(n % 3 != 0, _joined(" 10.5/C", tag)), title=F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("source")), abstract=_joined("<jats:p> ", F.col("text"), " </jats:p>"),
        author=F.array(F.struct(_every(2, "Ada").alias("given"), _joined("L", tag).alias("family"))), issued=F.struct(F.array(F.array(F.when(n % 5 != 0, (2000 + n % 20).cast("int")), F.lit(1))).alias("date-parts")), URL=_joined("https://x/", tag),
    )
    return _shown(R.crossref(raw))


@query(
    f"""SELECT doc_id AS seq, CASE WHEN doc_id % 3 <> 0 THEN '10.6/s' || doc_id WHEN doc_id % 4 = 1 THEN 's2:' || doc_id ELSE 's2:p' || doc_id END AS record_id, {TITLE} AS title, text AS abstract, ['N' || doc_id] AS authors,
  CAST(1990 + doc_id % 30 AS INT) AS year, CASE WHEN doc_id % 3 <> 0 THEN '10.6/s' || doc_id END AS doi, 'https://s/' || doc_id AS url, 'SemanticScholar' AS source_db, CASE WHEN doc_id % 2 = 0 THEN 'https://pdf/' || doc_id END AS oa_url FROM documents"""
)
def semantic_scholar_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, tag = _ids()
    raw = _raw(
        spark, sf_dir, paperId=F.when(n % 4 != 1, _joined("p", tag)), title=F.col("source"), abstract=F.col("text"), year=(1990 + n % 30).cast("int"), externalIds=F.struct(F.when(n % 3 != 0, _joined("10.6/S", tag)).alias("DOI")),
        authors=F.array(F.struct(_joined("N", tag).alias("name")), F.struct(F.lit("").alias("name"))), url=_joined("https://s/", tag), openAccessPdf=F.struct(_every(2, _joined("https://pdf/", tag)).alias("url")),
    )
    return _shown(R.semantic_scholar(raw), "oa_url")


@query(
    f"""SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN '10.7/e' || doc_id ELSE 'europepmc:' || CASE WHEN doc_id % 2 = 0 THEN 'MED:' ELSE 'EPMC:' END || doc_id END AS record_id, {TITLE} AS title, {BARE} AS abstract, ['Ada L', 'Bo M'] AS authors,
  CASE WHEN doc_id % 7 <> 0 THEN CAST(1980 + doc_id % 40 AS INT) END AS year, CASE WHEN doc_id % 3 = 0 THEN '10.7/e' || doc_id END AS doi, CASE WHEN doc_id % 3 = 0 THEN 'https://doi.org/10.7/e' || doc_id END AS url, 'EuropePMC' AS source_db FROM documents"""
)
def europe_pmc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, tag = _ids()
    raw = _raw(
        spark, sf_dir, id=F.when(n % 5 != 0, tag), source=_every(2, "MED"), doi=_every(3, _joined("10.7/E", tag)), title=F.col("source"), abstractText=_joined("<h4>", F.col("text"), "</h4>"), authorString=F.lit("Ada L, , Bo M"),
        pubYear=F.when(n % 7 == 0, "n.d.").otherwise((1980 + n % 40).cast("string")),
    )
    return _shown(R.europe_pmc(raw))


@query(
    f"""SELECT doc_id AS seq, CASE doc_id % 3 WHEN 0 THEN '10.3/e' || doc_id ELSE 'eric:ED' || doc_id END AS record_id, {TITLE} AS title, {BARE} AS abstract, ['First'] AS authors, CAST(2003 + doc_id % 9 AS INT) AS year,
  CASE WHEN doc_id % 3 = 0 THEN '10.3/e' || doc_id END AS doi, CASE doc_id % 3 WHEN 0 THEN 'https://doi.org/10.3/E' || doc_id WHEN 1 THEN 'https://eric.ed.gov/?id=ED' || doc_id ELSE 'https://e/' || doc_id END AS url, 'ERIC' AS source_db,
  'ED' || doc_id AS eric_id, CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END AS peer_reviewed FROM documents"""
)
def eric_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, tag = _ids()
    raw = _raw(
        spark, sf_dir, id=_joined("ED", tag), title=F.col("source"), description=F.col("text"), author=F.array(F.lit("First"), F.lit("")), publicationdateyear=_joined((2003 + n % 9).cast("string"), "-05"),
        url=F.when(n % 3 == 0, _joined("https://doi.org/10.3/E", tag)).when(n % 3 == 1, "").otherwise(_joined("https://e/", tag)), peerreviewed=F.when(n % 2 == 0, "T").otherwise("F"),
    )
    return _shown(R.eric(raw), "eric_id", "peer_reviewed")


@query(
    f"""SELECT doc_id AS seq, CASE WHEN doc_id % 2 = 0 THEN '10.4/d' || doc_id ELSE 'doaj:d' || doc_id END AS record_id, {TITLE} AS title, {BARE} AS abstract, ['Ada L'] AS authors, CAST(2010 AS INT) AS year, CASE WHEN doc_id % 2 = 0 THEN '10.4/d' || doc_id END AS doi,
  CASE WHEN doc_id % 2 = 0 THEN 'https://doi.org/10.4/d' || doc_id WHEN doc_id % 3 = 0 THEN 'https://f/' || doc_id END AS url, 'DOAJ' AS source_db, 'J' AS journal, 'en,es' AS language, CASE WHEN doc_id % 3 = 0 THEN 'https://f/' || doc_id END AS oa_url FROM documents"""
)
def doaj_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, tag = _ids()
    pair = lambda kind, value, name: F.struct(F.lit(kind).alias("type"), value.alias(name))
    doi = F.when(n % 2 == 0, "doi").otherwise("pissn")
    bib = F.struct(
        F.col("source").alias("title"), F.col("text").alias("abstract"), F.lit("2010").alias("year"), F.array(pair("eissn", F.lit("1234"), "id"), F.struct(doi.alias("type"), _joined("doi:10.4/D", tag).alias("id"))).alias("identifier"),
        F.array(pair("homepage", F.lit("h"), "url"), F.struct(F.when(n % 3 == 0, "fulltext").otherwise("other").alias("type"), _joined("https://f/", tag).alias("url"))).alias("link"),
        F.array(F.struct(F.lit("Ada L").alias("name"))).alias("author"), F.struct(F.lit("J").alias("title"), F.array(F.lit("en"), F.lit("es")).alias("language")).alias("journal"),
    )
    return _shown(R.doaj(_raw(spark, sf_dir, id=_joined("d", tag), bibjson=bib)), "journal", "language", "oa_url")


@query(
    f"""SELECT doc_id AS seq, CASE WHEN doc_id % 2 = 0 THEN '10.2/p' || doc_id ELSE 'pmc:' || doc_id END AS record_id, {TITLE} AS title, NULL::VARCHAR AS abstract, ['Ada L', 'Bo M'] AS authors, CASE WHEN doc_id % 4 <> 0 THEN CAST(2011 AS INT) END AS year,
  CASE WHEN doc_id % 2 = 0 THEN '10.2/p' || doc_id END AS doi, 'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || doc_id || '/' AS url, 'PMC' AS source_db, 'PMC' || doc_id AS pmcid FROM documents"""
)
def pmc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, tag = _ids()
    ids = F.array(*[F.struct(F.lit(kind).alias("idtype"), value.alias("value")) for kind, value in (("pmid", tag), ("doi", F.lit("10.1/first")), ("DOI", F.when(n % 2 == 0, _joined("10.2/P", tag)).otherwise("")))])
    people = F.array(*[F.struct(F.lit(name).alias("name")) for name in ("Ada L", "Bo M")])
    return _shown(R.pmc_summaries(_raw(spark, sf_dir, uid=tag, title=F.col("source"), pubdate=F.when(n % 4 == 0, "Winter 2011").otherwise("2011 Dec"), articleids=ids, authors=people)), "pmcid")


@query(
    f"""SELECT doc_id AS seq, 'unesdoc:' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'u' END || doc_id AS record_id, {TITLE} AS title, {BARE} AS abstract, CASE WHEN doc_id % 2 = 0 THEN ['Office'] ELSE []::VARCHAR[] END AS authors, CAST(2010 AS INT) AS year, NULL::VARCHAR AS doi,
  'https://un/' || doc_id AS url, 'UNESDOC' AS source_db, 'en,fr' AS language, 'book' AS document_type, NULL::VARCHAR AS isbn FROM documents"""
)
def unesdoc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, tag = _ids()
    raw = _raw(
        spark, sf_dir, uuid=F.when(n % 3 != 0, _joined("u", tag)), title=F.col("source"), description=F.col("text"), creator=F.when(n % 2 == 0, "Office").otherwise(""), year=F.array(F.lit("2010"), F.lit("2011")), url=_joined("https://un/", tag),
        language=F.array(F.lit("en"), F.lit("fr")), document_type=F.lit("book"), isbn=F.lit(""),
    )
    return _shown(R.unesdoc(raw), "language", "document_type", "isbn")


@query(
    f"""SELECT doc_id AS seq, 'bvs:b' || doc_id AS record_id, {TITLE} AS title, {BARE} AS abstract, ['Ada L', 'Bo M'] AS authors, CASE WHEN doc_id % 2 = 0 THEN CAST(2015 AS INT) END AS year, NULL::VARCHAR AS doi, 'https://b/' || doc_id AS url, 'BVS' AS source_db FROM documents"""
)
def portal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, tag = _ids()
    raw = _raw(
        spark, sf_dir, key=_joined("b", tag), ti=F.array(F.col("source"), F.lit("other")), ab=F.array(F.col("text"), F.lit("other")), au=F.array(F.lit("Ada L"), F.lit("Bo M")), da=F.when(n % 2 == 0, "201503").otherwise("s.f."), ur=F.array(_joined("https://b/", tag)),
    )
    return _shown(R.first_of_list(raw, "bvs", "BVS", id_col="key", title_col="ti", abstract_col="ab", author_col="au", date_col="da", url_col="ur"))


@query(
    f"""SELECT doc_id AS seq, CASE WHEN doc_id % 2 = 0 THEN '10.8/r' || doc_id ELSE 'repo:h' || doc_id END AS record_id, coalesce(nullif(source, ''), 'second') AS title, {BARE} AS abstract, CASE WHEN doc_id % 3 = 0 THEN ['Main A'] ELSE ['Other B', 'Other C'] END AS authors, CAST(2017 AS INT) AS year,
  CASE WHEN doc_id % 2 = 0 THEN '10.8/r' || doc_id END AS doi, CASE WHEN doc_id % 2 = 0 THEN 'https://doi.org/10.8/R' || doc_id ELSE 'https://r/' || doc_id END AS url, 'Repo' AS source_db, CASE WHEN length(source) > 0 THEN 'second; third' ELSE 'third' END AS titles, 'es' AS language FROM documents"""
)
def repository_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tag = _ids()
    fields = [
        ("dc.title", F.col("source")), ("dc.title", F.lit("second")), ("dc.title", F.lit("third")), ("dc.description.abstract", F.col("text")), ("dc.creator", F.lit("Other B")), ("dc.creator", F.lit("Other C")),
        ("dc.contributor.author", _every(3, "Main A")), ("dc.date.issued", F.lit("2017-05")), ("dc.identifier.uri", _every(2, _joined("https://doi.org/10.8/R", tag))), ("dc.language", F.lit("es")),
    ]
    listed = F.array(*[F.struct(F.lit(place).alias("place"), F.lit(key).alias("key"), value.alias("value")) for place, (key, value) in enumerate(fields)])
    meta = R.metadata_map(_raw(spark, sf_dir, one=F.explode(listed)).select("seq", "one.*"), "seq", "key", "value", "place")
    text = F.col("seq").cast("string")
    return _shown(R.dublin_core(meta.withColumns({"native_id": _joined("h", text), "url_fallback": _joined("https://r/", text)}), "Repo"), "titles", "language")


@query(
    """SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN '10.1/m' || doc_id WHEN doc_id % 3 = 1 THEN '10.1/l' || doc_id ELSE 'pubmed:' || doc_id END AS record_id, 'On ' || doc_id AS title, 'Aim. End.' AS abstract, ['Ada Lo', 'Bo'] AS authors, CAST(CASE WHEN doc_id % 2 = 0 THEN 1998 ELSE 2004 END AS INT) AS year,
  CASE doc_id % 3 WHEN 0 THEN '10.1/m' || doc_id WHEN 1 THEN '10.1/l' || doc_id END AS doi, CASE doc_id % 3 WHEN 0 THEN 'https://doi.org/10.1/m' || doc_id WHEN 1 THEN 'https://doi.org/10.1/l' || doc_id ELSE 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' END AS url,
  'PubMed' AS source_db, doc_id::VARCHAR AS pmid, 'PMC' || doc_id AS pmcid FROM documents"""
)
def pubmed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, tag = _ids()
    date = F.when(n % 2 == 0, "<MedlineDate>1998 Dec-1999 Jan</MedlineDate>").otherwise("<Year>2004</Year>")
    doi = F.when(n % 3 == 0, _joined('<ArticleId IdType="doi">10.1/M', tag, "</ArticleId>")).otherwise("")
    other = F.when(n % 3 != 2, _joined('<ELocationID EIdType="doi">10.1/L', tag, "</ELocationID>")).otherwise("")
    xml = _joined(
        "<PubmedArticle><PMID>", tag, "</PMID><ArticleTitle>On ", tag, "</ArticleTitle><Abstract><AbstractText>Aim. </AbstractText><AbstractText>End.</AbstractText></Abstract><AuthorList><Author><ForeName>Ada</ForeName><LastName>Lo</LastName></Author>",
        "<Author><LastName>Bo</LastName></Author></AuthorList><PubDate>", date, '</PubDate><ArticleIdList><ArticleId IdType="pmc">PMC', tag, "</ArticleId>", doi, "</ArticleIdList>", other, "</PubmedArticle>",
    )
    raw = _raw(spark, sf_dir, article=F.from_xml(xml, F.lit(R.PUBMED))).select("seq", "article.*")
    return _shown(R.pubmed(raw), "pmid", "pmcid")


@query(
    """WITH d AS (SELECT doc_id, '10.1/' || doc_id AS doi FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'PMC0' WHEN doc_id % 3 <> 0 THEN 'PMC' || doc_id END AS pmcid, CASE WHEN doc_id % 5 = 0 THEN 'own' WHEN doc_id % 2 = 0 THEN 'https://found/' || doc_id END AS open_url FROM d"""
)
def fulltext_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, tag = _ids()
    docs = read(spark, sf_dir, "documents").select(n)
    own = R.extras(pmcid=_every(4, "PMC0"), pmid=_every(2, _joined("9", tag)), oa_url=_every(5, "own"))
    records = docs.select(n, _joined("10.1/", tag).alias("doi"), own.alias("extra"))
    pairs = docs.select(_joined("10.1/", tag).alias("doi"), _joined("9", tag).alias("pmid"), F.when(n % 3 != 0, _joined("PMC", tag)).alias("pmcid"))
    urls = docs.where("doc_id % 2 = 0").select(_joined("10.1/", tag).alias("doi"), _joined("https://found/", tag).alias("url"))
    return R.open_url(R.with_pmcid(records, R.id_lookup(pairs)), urls).select("doc_id", "pmcid", "open_url")


@query("""SELECT DISTINCT 'u' || user_id AS record_id, sha256('["' || event_type || '"]') AS input_sha256, upper(event_type) AS output FROM events""")
def journal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of requests; the journal lies in the shared folder."""
    folder = shared_folder(spark)
    # a stream reads a single file through a pattern only
    events = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    requests = journal.keyed(events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("record_id"), F.col("event_type").alias("input"), F.col("event_id").alias("seq")), F.col("input"))
    answer = lambda rows: rows.withColumn("output", F.upper("input"))
    journal.run_stream(spark, requests, f"{folder}/journal", f"{folder}/marks", answer).awaitTermination()
    return journal.read_journal(spark, f"{folder}/journal").select(*journal.KEY, "output")


@query(
    """SELECT CASE WHEN doc_id % 97 = 5 THEN 'malformed' ELSE 'article' END AS kind, count(*) AS n, CAST(sum(CASE WHEN doc_id % 97 <> 5 THEN doc_id END) AS BIGINT) AS ids, count(CASE WHEN doc_id % 97 <> 5 AND doc_id % 3 = 0 THEN 1 END) AS with_doi,
  CAST(coalesce(sum(CASE WHEN doc_id % 97 <> 5 THEN length('On ' || coalesce(source, '') || ' & ' || doc_id) END), 0) AS BIGINT) AS title_chars FROM documents GROUP BY 1"""
)
def article_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as XML articles in files, some of them not well formed, read back by their ends."""
    n, tag = _ids()
    escaped = F.replace(F.coalesce("source", F.lit("")), F.lit("&"), F.lit("&amp;"))
    doi = F.when(n % 3 == 0, _joined('<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/M', tag, "</ArticleId></ArticleIdList></PubmedData>")).otherwise("")
    xml = _joined('<PubmedArticle><MedlineCitation><PMID Version="1">', tag, "</PMID><Article><ArticleTitle>On ", escaped, " &amp; ", tag, F.when(n % 97 == 5, "</Title>").otherwise("</ArticleTitle>"), "</Article></MedlineCitation>", doi, "</PubmedArticle>")
    folder = shared_folder(spark)
    read(spark, sf_dir, "documents").select(xml.alias("value")).write.text(folder)
    good, bad = articles.read_articles(spark, folder)
    found = R.pubmed(good).select(F.lit("article").alias("kind"), F.try_element_at("extra", F.lit("pmid")).cast("long").alias("id"), "doi", "title")
    rows = found.unionByName(bad.select(F.lit("malformed").alias("kind")), allowMissingColumns=True)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.count("doi").alias("with_doi"), F.coalesce(F.sum(F.length("title")), F.lit(0)).cast("long").alias("title_chars"))


GATES_SQL = """WITH e AS (SELECT user_id, event_id, 'u' || user_id AS run, ['screening_ta', 'screening_ft', 'extraction', 'rob', 'report'][1 + event_id % 5] AS stage, event_id AS seq, event_type, 'r' || (event_id % 2) AS sha FROM events),
g AS (SELECT run, stage, max(seq) FILTER (event_type IN ('view', 'click')) AS asked, max(seq) FILTER (event_type NOT IN ('view', 'click', 'error')) AS given FROM e GROUP BY 1, 2),
j AS (SELECT g.run, g.stage, asked, given, greatest(asked, given) AS seq, r.sha AS sha, 'A' || (r.event_id % 3) AS autonomy, r.event_id % 7 = 0 AS forced, r.event_id % 11 = 0 AS unresolved, r.event_id % 13 < 6 AS auto, d.sha AS given_sha, d.event_type = 'purchase' AS approved, CASE WHEN d.event_id % 3 = 0 THEN 'ana' ELSE 'human:u' || (d.event_id % 9) END AS actor
  FROM g LEFT JOIN e r ON r.seq = asked LEFT JOIN e d ON d.seq = given WHERE asked IS NOT NULL OR given IS NOT NULL),
s AS (SELECT *, autonomy = 'A2' AND NOT forced AS alone, given IS NULL AND NOT forced AND NOT unresolved AND auto AS demo, given IS NOT NULL AND given_sha = sha AND (NOT forced OR actor LIKE 'human:%') AS counts FROM j),
v AS (SELECT *, CASE WHEN asked IS NULL THEN 'open' WHEN alone OR demo THEN 'approved' WHEN counts THEN CASE WHEN approved THEN 'approved' ELSE 'rejected' END ELSE 'paused' END AS state FROM s)
SELECT run, stage, state, CASE WHEN state = 'paused' THEN CASE WHEN given IS NOT NULL AND given_sha <> sha THEN 'other_request' WHEN given IS NOT NULL THEN 'not_a_person' WHEN forced OR unresolved THEN 'person_needed' ELSE 'undecided' END END AS reason,
  CASE WHEN asked IS NULL THEN NULL WHEN alone THEN 'agent:' || stage WHEN demo THEN 'auto-approve (demo)' WHEN state IN ('approved', 'rejected') THEN actor END AS actor, sha AS request_sha256, seq FROM v"""


def _gate_events(events: DataFrame) -> DataFrame:
    """Views and clicks ask a gate, errors are of no kind that a gate knows, the others decide."""
    n, kind = F.col("event_id"), F.col("event_type")
    asked = kind.isin("view", "click")
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run"), F.get(F.array(*[F.lit(s) for s in ledger.STAGES]), (n % 5).cast("int")).alias("stage"), n.alias("seq"), "ts",
        F.when(asked, "request").when(kind == "error", "error").otherwise("decision").alias("kind"), F.concat(F.lit("r"), (n % 2).cast("string")).alias("request_sha256"), F.when(asked, F.concat(F.lit("A"), (n % 3).cast("string"))).alias("autonomy"),
        (asked & (n % 7 == 0)).alias("forced"), (asked & (n % 11 == 0)).alias("unresolved"), (asked & (n % 13 < 6)).alias("auto_approve"), (kind == "purchase").alias("approved"),
        F.when(n % 3 == 0, "ana").otherwise(F.concat(F.lit("human:u"), (n % 9).cast("string"))).alias("actor"),
    )


@query(GATES_SQL)
def gate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.states(_gate_events(read(spark, sf_dir, "events")))


@query(GATES_SQL)
def gate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as a stream, whose gates wait in keyed state."""
    folder = shared_folder(spark)
    events = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    gates.run_gates(spark, _gate_events(events), f"{folder}/states", f"{folder}/progress", patience=timedelta(days=3650)).awaitTermination()
    return gates.latest(spark.read.parquet(f"{folder}/states"))


@query(
    """WITH b AS (SELECT coalesce(source, '') AS backend, count(*) AS n FROM documents GROUP BY 1)
SELECT backend, sha256('q ' || backend) AS query_sha256, CASE WHEN length(backend) % 2 = 0 THEN 'ok' ELSE 'error' END AS status, CASE WHEN length(backend) % 2 = 0 THEN n ELSE 0 END AS n_returned, CASE WHEN length(backend) % 2 = 1 THEN 'down' END AS failure,
  (SELECT count(*) FROM documents WHERE length(coalesce(source, '')) % 2 = 0) AS n_records, (SELECT CAST(sum(doc_id) AS BIGINT) FROM documents WHERE length(coalesce(source, '')) % 2 = 0) AS ids FROM b"""
)
def frozen_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over backends, some of them down, committed as one and read again; the second call must not search."""
    folder = shared_folder(spark)
    docs = read(spark, sf_dir, "documents").withColumn("backend", F.coalesce("source", F.lit("")))
    down = F.length("backend") % 2 == 1
    asked = docs.select("backend").distinct().select("backend", F.concat(F.lit("q "), "backend").alias("query"), F.when(down, "error").otherwise("ok").alias("status"), F.when(down, "down").alias("error"))
    frozen.memoised(spark, folder, lambda: frozen.search_tables(docs.where(~down).select("backend", "doc_id", "lang"), asked))
    tables = frozen.memoised(spark, folder, lambda: {})
    of = tables["failures"].select(F.col("backend").alias("of"), F.col("error").alias("failure"))
    whole = tables["records"].agg(F.count(F.lit(1)).alias("n_records"), F.sum("doc_id").alias("ids"))
    return tables["log"].join(of, F.col("backend") == F.col("of"), "left").crossJoin(whole).select("backend", "query_sha256", "status", "n_returned", "failure", "n_records", "ids")


@query(
    """WITH f AS (SELECT doc_id // 100 AS part, string_agg(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY 1)
SELECT 'part=' || part AS path, CASE part % 4 WHEN 1 THEN 'changed' WHEN 2 THEN 'removed' WHEN 3 THEN 'added' ELSE 'same' END AS change, sha256(body) AS sha256 FROM f"""
)
def file_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a hundred each, with both kinds of line ends, against a frozen table that differs in a known way."""
    folder = shared_folder(spark)
    parts = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    parts.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").option("lineSep", "\r\n").text(f"{folder}/files")
    now = frozen.fingerprints(spark, f"{folder}/files", "*.txt").withColumn("path", F.regexp_extract("path", "^(part=[0-9]+)/", 1))
    kind = F.regexp_extract("path", "[0-9]+", 0).cast("long") % 4
    before = frozen.ensure_snapshot(spark, f"{folder}/frozen", now.where(kind != 3).withColumn("sha256", F.when(kind == 1, "other").otherwise(F.col("sha256"))))
    told = frozen.changes(before, now.where(kind != 2)).withColumnRenamed("path", "of")
    return now.join(told, F.col("path") == F.col("of"), "left").select("path", F.coalesce("change", F.lit("same")).alias("change"), "sha256")


@query(
    """WITH d AS (SELECT doc_id, greatest(n_chars, 0) AS need, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rank, count(*) OVER () AS n, sum(n_chars) OVER (ORDER BY n_chars, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken FROM documents),
t AS (SELECT *, 1000 * n AS total FROM d),
f AS (SELECT min(rank) AS first, arg_min(coalesce(taken, 0), rank) AS taken FROM t WHERE need * (n - rank) > total - coalesce(taken, 0))
SELECT doc_id, need, CAST(CASE WHEN first IS NULL OR rank < first THEN need ELSE (total - f.taken) // (n - first) + CASE WHEN rank >= n - (total - f.taken) % (n - first) THEN 1 ELSE 0 END END AS BIGINT) AS share FROM t, f"""
)
def fair_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand characters a document, shared over all of them."""
    docs = read(spark, sf_dir, "documents")
    return budget.fair_shares(docs, "doc_id", "n_chars", 1000 * docs.count())


@query("SELECT 'u' || user_id AS slug, count(*) AS n_runs, CAST(arg_max(epoch_us(ts), event_id) AS BIGINT) AS last_us, arg_max(event_type, event_id) AS last_included, min(event_id) AS first_seq FROM events GROUP BY 1")
def kept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of reviews, one review a user, indexed batch by batch as they stream in."""
    folder = shared_folder(spark)
    events = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    runs = events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("slug"), F.col("event_id").alias("seq"), "ts", F.array("event_type").alias("included_ids"))
    index.keep_index(runs, f"{folder}/index", f"{folder}/progress").awaitTermination()
    found = index.read_index(spark, f"{folder}/index")
    return found.select("slug", "n_runs", F.unix_micros("last_ts").alias("last_us"), F.get("last_included", F.lit(0)).alias("last_included"), "first_seq")


# --- validated loading -------------------------------------------------------------------------------------------------

RAW_SQL = """raw AS (SELECT doc_id AS n, doc_id % 23 = 0 AS torn, doc_id % 7 = 0 AS no_id, doc_id % 6 = 0 AS no_list, doc_id % 11 = 0 AS odd FROM documents), sound AS (SELECT * FROM raw WHERE NOT torn),
votes AS (SELECT n, unnest([0, 1]) AS v FROM sound WHERE NOT no_list),
faults AS (SELECT n AS id, '' AS path, 'not JSON' AS fault, NULL AS found FROM raw WHERE torn UNION ALL SELECT n, '.record_id', 'missing', NULL FROM sound WHERE no_id
  UNION ALL SELECT n, '.votes', 'kind', 'object' FROM sound WHERE no_list UNION ALL SELECT n, '.final_label', 'choice', '"maybe"' FROM sound WHERE odd
  UNION ALL SELECT n, '.votes[0].confidence', CASE WHEN n % 9 = 0 THEN 'kind' ELSE 'range' END, CASE WHEN n % 9 = 0 THEN '"high"' ELSE '1.5' END FROM votes WHERE v = 0 AND (n % 9 = 0 OR n % 4 = 3)
  UNION ALL SELECT n, '.votes[1].label', 'missing', NULL FROM votes WHERE v = 1 AND n % 13 = 0)"""


def _raw_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision a document, as JSON with faults of every kind."""
    n, tag = _ids()
    grade = F.when(n % 9 == 0, '"high"').otherwise(F.get(F.array(F.lit("0"), F.lit("0.5"), F.lit("1"), F.lit("1.5")), (n % 4).cast("int")))
    second = F.when(n % 13 == 0, '{"model":"b","confidence":0.25}').otherwise('{"model":"b","label":"exclude","confidence":0.25,"note":[1,{"x":null}]}')
    votes = F.when(n % 6 == 0, "{}").otherwise(_joined('[{"model":"a","label":"include","confidence":', grade, "},", second, "]"))
    own = F.when(n % 7 == 0, "").otherwise(_joined('"record_id":"d', tag, '",'))
    whole = _joined("{", own, '"final_label":', F.when(n % 11 == 0, '"maybe"').otherwise("null"), ',"votes":', votes, "}")
    return read(spark, sf_dir, "documents").select("doc_id", F.when(n % 23 == 0, F.substring(whole, 1, 12)).otherwise(whole).alias("raw"))


@query(f"WITH {RAW_SQL} SELECT id, path, fault, found FROM faults")
def decision_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated.load(_raw_decisions(spark, sf_dir), "doc_id", "raw", validated.DECISION)[1].drop("expected")


@query(f"WITH {RAW_SQL} SELECT n AS doc_id FROM raw WHERE n NOT IN (SELECT id FROM faults)")
def sound_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated.load(_raw_decisions(spark, sf_dir), "doc_id", "raw", validated.DECISION)[0].select("doc_id")
