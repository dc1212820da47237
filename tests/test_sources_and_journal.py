import json

import pytest
from pyspark.sql import functions as F

from metasift.operators import audit, exports, flow, ledger, screening
from metasift.plans import queries
from metasift.sources import records as R
from metasift.streaming import journal

RIS = """TY  - JOUR
TI  - A title
AU  - Perez, A
AU  - Diaz, B
PY  - 2020/01
DO  - https://doi.org/10.1/X
AB  - Text
ER  -
TY  - JOUR
T1  - Only title
"""
BIB = """@article{k1, title = {The  title}, author = {A and B}, year = "2019", doi={10.2/Y}}
@misc{empty}
@book{k2, title = "Second"}
"""


def test_import_folder(spark, tmp_path):
    (tmp_path / "a.ris").write_text(RIS, encoding="utf-8")
    (tmp_path / "b.bib").write_text(BIB, encoding="utf-8")
    (tmp_path / "c.bib").write_bytes(b"@article{x, title={\xff\xfe}}")
    records, unreadable = R.import_folder(spark, str(tmp_path))
    rows = {r.record_id: r for r in records.collect()}
    first = rows["10.1/x"]
    assert (first.title, first.authors, first.year, first.doi, first.abstract) == ("A title", ["Perez, A", "Diaz, B"], 2020, "https://doi.org/10.1/x", "Text")
    assert (rows["10.2/y"].title, rows["10.2/y"].authors, rows["10.2/y"].year) == ("The title", ["A", "B"], 2019)
    assert sum(k.startswith("hash:") for k in rows) == 2
    assert unreadable.count() == 1


def test_inverted_index(spark):
    rows = spark.createDataFrame([({"Hello": [0, 2], "world": [1]},), ({},)], "i map<string,array<int>>").select(R.abstract_of(F.col("i")).alias("a")).collect()
    assert [r.a for r in rows] == ["Hello world Hello", None]


@pytest.mark.parametrize(
    ("schema", "mapper", "answer", "expected"),
    [
        (R.CROSSREF, R.crossref, {"DOI": "10.1/A", "title": ["T"], "abstract": "<p>x</p>", "author": [{"given": "G", "family": "F"}, {"family": "H"}], "issued": {"date-parts": [[2021, 2]]}, "URL": "u"}, ("10.1/a", "T", "x", ["G F", "H"], 2021)),
        (R.SEMANTIC, R.semantic_scholar, {"paperId": "p", "title": "", "year": 2020, "authors": [{"name": "N"}, {"name": ""}]}, ("s2:p", "(sin título)", None, ["N"], 2020)),
        (R.EUROPEPMC, R.europe_pmc, {"id": "7", "source": "MED", "title": "T", "authorString": "A B, C D,", "pubYear": "x"}, ("europepmc:MED:7", "T", None, ["A B", "C D"], None)),
        (R.ERIC, R.eric, {"id": "EJ1", "title": "T", "author": ["A"], "publicationdateyear": "2019", "url": "https://doi.org/10.3/Z", "peerreviewed": "T"}, ("10.3/z", "T", None, ["A"], 2019)),
        (R.DOAJ, R.doaj, {"id": "d", "bibjson": {"title": "T", "year": "2018", "identifier": [{"type": "issn", "id": "1"}, {"type": "doi", "id": "doi:10.4/W"}], "link": [{"type": "fulltext", "url": "f"}], "author": [{"name": "A"}]}}, ("10.4/w", "T", None, ["A"], 2018)),
    ],
)
def test_source_answers(spark, schema, mapper, answer, expected):
    raw = spark.createDataFrame([(0, json.dumps(answer))], "seq long, j string").select("seq", F.from_json("j", schema).alias("d")).select("seq", "d.*")
    row = mapper(raw).first()
    assert (row.record_id, row.title, row.abstract, row.authors, row.year) == expected


def test_pubmed_xml(spark):
    xml = """<PubmedArticle><PMID>5</PMID><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>a </AbstractText><AbstractText>b</AbstractText></Abstract>
    <PubDate><MedlineDate>1998 Dec</MedlineDate></PubDate><ArticleIdList><ArticleId IdType="pmc">PMC1</ArticleId><ArticleId IdType="doi">10.5/V</ArticleId></ArticleIdList></PubmedArticle>"""
    raw = spark.createDataFrame([(0, xml)], "seq long, x string").select("seq", F.from_xml("x", F.lit(R.PUBMED)).alias("d")).select("seq", "d.*")
    row = R.pubmed(raw).first()
    assert (row.record_id, row.abstract, row.year, row.extra) == ("10.5/v", "a b", 1998, {"pmid": "5", "pmcid": "PMC1"})


def test_dublin_core(spark):
    rows = spark.createDataFrame([(1, "dc.title", "A", 0), (1, "dc.title", "B", 1), (1, "dc.identifier.uri", "https://doi.org/10.6/U", 2), (1, "dc.creator", "X", 3), (1, "dc.date.issued", "2017-05", 4), (1, "dc.title", "", 5)], "item long, key string, value string, pos long")
    meta = R.metadata_map(rows, "item", "key", "value", "pos").select(F.col("item").alias("seq"), "meta", F.lit("n1").alias("native_id"), F.lit("u").alias("url_fallback"))
    row = R.dublin_core(meta, "Repo").first()
    assert (row.record_id, row.title, row.authors, row.year, row.extra) == ("10.6/u", "A", ["X"], 2017, {"titles": "B"})


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n{"a": ', encoding="utf-8")
    rows = R.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a long").orderBy("line_no").collect()
    assert [(r.line_no, r.status, r.a) for r in rows] == [(1, "ok", 1), (2, "bad", None), (3, "ok", 2), (4, "torn", None)]


def test_pmcid_and_open_url(spark):
    records = spark.createDataFrame([("a", "10.1/A", {"pmcid": "PMC9"}), ("b", "10.1/B", {}), ("c", None, {"oa_url": "o"})], "record_id string, doi string, extra map<string,string>")
    lookup = R.id_lookup(spark.createDataFrame([("10.1/B", "77", "PMC2")], "doi string, pmid string, pmcid string"))
    assert {r.record_id: r.pmcid for r in R.with_pmcid(records, lookup).collect()} == {"a": "PMC9", "b": "PMC2", "c": None}
    urls = spark.createDataFrame([("10.1/B", "w")], "doi string, url string")
    assert {r.record_id: r.open_url for r in R.open_url(records, urls).collect()} == {"a": None, "b": "w", "c": "o"}


class TestJournal:
    def requests(self, spark, *inputs):
        return journal.keyed(spark.createDataFrame([(r, i, n) for n, (r, i) in enumerate(inputs)], "record_id string, input string, seq long"), F.col("input"))

    def test_replay(self, spark):
        first = self.requests(spark, ("a", "x"), ("a", "x"), ("b", None))
        none = first.where("false").withColumn("output", F.lit(""))
        done = journal.run_batch(first, none, lambda df: df.withColumn("output", F.lit("o")))
        assert done.count() == 2
        later = self.requests(spark, ("a", "x"), ("a", "y"))
        assert [r.input for r in journal.pending(later, done).collect()] == ["y"]

    def test_stream(self, spark, tmp_path):
        source, sink, marks = (str(tmp_path / x) for x in ("in", "journal", "marks"))
        compute = lambda df: df.withColumn("output", F.upper("input"))
        for part in (self.requests(spark, ("a", "x"), ("b", "y")), self.requests(spark, ("a", "x"), ("c", "z"))):
            part.write.mode("append").parquet(source)
            stream = spark.readStream.schema(part.schema).parquet(source)
            journal.run_stream(spark, stream, sink, marks, compute).awaitTermination()
        rows = journal.read_journal(spark, sink).collect()
        assert sorted((r.record_id, r.output) for r in rows) == [("a", "X"), ("b", "Y"), ("c", "Z")]
        assert journal.conflicts(journal.read_journal(spark, sink)).isEmpty()

    def test_transient_failures_are_retried(self, spark):
        rows = spark.createDataFrame([("a", None), ("b", "error_http"), ("c", "sin_oa")], "record_id string, reason string")
        assert {r.record_id for r in journal.lasting(rows).collect()} == {"a", "c"}


class TestAudit:
    """Start from a consistent run, break one table, see which relation notices."""

    @pytest.fixture(scope="class")
    def tables(self, spark):
        docs = spark.createDataFrame([(i, i, f"t{i}", "s1" if i % 2 else "s2") for i in range(12)], "record_id long, seq long, title string, source_db string").withColumns({"year": F.lit(None).cast("int"), "doi": F.lit(None).cast("string"), "lang": F.lit("en"), "text": F.lit("x"), "doc_id": F.col("seq")})
        r = F.col("record_id")
        decided = docs.select("record_id", "seq", F.when(r % 3 == 0, "exclude").otherwise("include").alias("ensemble_label"), F.lit(None).cast("string").alias("fulltext_status"))
        labels = docs.where("record_id = 3").select("record_id", F.lit("include").alias("label"), F.lit(None).cast("string").alias("reason"), F.lit("human:a").alias("actor"))
        screened = screening.apply_labels(decided, labels)
        ft = screened.where(screening.passes(F.col("final_label"))).select("record_id", "seq", F.when(r % 5 == 0, "exclude").otherwise("include").alias("ensemble_label"), F.lit("retrieved").alias("fulltext_status"), F.array(F.lit("why")).alias("criteria"))
        fulltext = screening.apply_labels(ft, labels.where("false"))
        reports = screening.excluded_reports(fulltext, docs)
        return {"counts": flow.flow_counts(docs, docs, screened, fulltext, reports), "records": docs, "dedup": docs, "duplicates": docs.where("false"), "screened": screened, "fulltext": fulltext, "reports": reports, "votes": screened.select("record_id", F.col("ensemble_label").alias("label"))}

    def broken(self, spark, tables, **changes):
        found = audit.relations(audit.Run(spark, tables | changes)).where("NOT ok").collect()
        return {(r.family, r.name) for r in found}

    def test_consistent(self, spark, tables):
        assert self.broken(spark, tables) == set()

    def test_lost_record(self, spark, tables):
        assert ("1", "identified = records") in self.broken(spark, tables, records=tables["records"].where("record_id <> 5"))

    def test_wrong_label(self, spark, tables):
        bad = tables["screened"].withColumn("final_label", F.when(F.col("record_id") == 4, "exclude").otherwise(F.col("final_label")))
        names = {name for _, name in self.broken(spark, tables, screened=bad)}
        assert "final label = human label, else ensemble label" in names
        assert "excluded_ta = excluded decisions" in names

    def test_wrong_order(self, spark, tables):
        bad = tables["screened"].withColumn("seq", -F.col("seq"))
        assert ("5", "decisions in the order of unique records") in self.broken(spark, tables, screened=bad)

    def test_wrong_reason(self, spark, tables):
        bad = tables["reports"].withColumn("reason", F.lit("other"))
        assert ("9", "reports follow the decisions") in self.broken(spark, tables, reports=bad)

    def test_missing_table_is_unverifiable(self, spark, tables):
        few = {k: v for k, v in tables.items() if k != "votes"}
        rows = audit.relations(audit.Run(spark, few)).where("family = '5'").collect()
        assert [r.ok for r in rows] == [None]

    def test_checks_fail_closed(self, spark, tables):
        rows = {r.check_id: r.status for r in audit.checks(audit.Run(spark, tables, registration="x")).collect()}
        assert rows["arithmetic"] == "WARN"
        assert rows["exclusions"] == "PASS"
        assert rows["manifest"] == "FAIL"  # N/A without any failure elsewhere
        assert audit.report(audit.local(spark.createDataFrame([("a", "PASS", "")], audit.CHECK))).first().publishable


    def test_gates_provenance_and_search_log(self, spark, tables):
        log = spark.createDataFrame([(n, s, "approve", "human:ana", None, "r", "d", None, None) for n, s in enumerate(ledger.STAGES)], "seq long, stage string, action string, actor string, target string, request_sha256 string, decision_sha256 string, to_label string, reason string")
        label = spark.createDataFrame([(9, "screening_ta", "label", "human:ana", "3", "r", "d", "include", None)], log.schema)
        requests = spark.createDataFrame([(s, "r") for s in ledger.STAGES], "stage string, sha256 string")
        search = spark.sql("SELECT 'Open Alex' AS database, 'openalex' AS db_key, 'database' AS kind, 'ok' AS status, 12 AS n_returned, array('s1', 's2') AS source_db, 'q' AS query, sha2('q', 256) AS query_sha256, 'inline' AS query_origin")
        run = {**tables, "log": log.unionAll(label), "requests": requests, "search_log": search, "databases": spark.sql("SELECT 'Open Alex' AS database"), "manifest": spark.sql("SELECT 'pipeline' AS provenance")}
        status = lambda **changes: {r.check_id: r.status for r in audit.checks(audit.Run(spark, run | changes)).collect()}
        sound = status()
        assert (sound["hitl"], sound["provenance"], sound["search_log"]) == ("PASS", "PASS", "PASS")
        machine = log.withColumn("actor", F.when(F.col("stage") == "rob", ledger.AUTO_APPROVER).otherwise(F.col("actor")))
        bad = status(log=machine.unionAll(label), search_log=search.withColumn("query", F.lit("other")), manifest=spark.sql("SELECT CAST(NULL AS string) AS provenance"))
        assert (bad["hitl"], bad["provenance"], bad["search_log"]) == ("FAIL", "FAIL", "FAIL")


def test_exports(spark):
    records = spark.createDataFrame([("10.1/a", "A {title}", ["X", "Y"], 2020, "10.1/a", None), ("b", "B", [], None, None, "u")], "record_id string, title string, authors array<string>, year int, doi string, url string")
    entries = {r.record_id: r.entry for r in exports.bibtex(records).collect()}
    assert entries["10.1/a"].startswith("@article{10_1_a,\n  title = {A title},\n  author = {X and Y}")
    assert entries["b"].startswith("@misc{b,")
    table = spark.createDataFrame([("s", 0.2, None)], "study_id string, yi double, label string")
    assert exports.csv_text(table) == "study_id,yi,label\ns,0.2,\n"
    fields = spark.createDataFrame([("s1", "z", "1", "found", 1), ("s1", "a", None, "needs_review", 2), ("s2", "a", "v", "needs_review", 3)], "study_id string, key string, value string, status string, seq long")
    assert exports.extraction_table(fields).columns == ["study_id", "z", "a"]


def test_queries_run_without_the_training_part():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
