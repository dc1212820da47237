import json
import threading
import time
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from metasift.sources import articles, paged
from metasift.sources import records as R


class Library:
    """A search interface with ``total`` items that fails before it answers."""

    def __init__(self, total, failing=None):
        self.total, self.failing, self.calls, self.lock = total, failing or (lambda address, n: None), [], threading.Lock()
        library = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_):
                pass

            def do_GET(self):  # noqa: N802
                with library.lock:
                    library.calls.append((time.monotonic(), self.path))
                    n = sum(p == self.path for _, p in library.calls)
                code = library.failing(self.path, n)
                body = b"" if code else library.answer(urllib.parse.urlsplit(self.path))
                self.send_response(code or 200)
                if code == 429:
                    self.send_header("Retry-After", "0.05")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    def answer(self, address):
        asked = {k: v[0] for k, v in urllib.parse.parse_qs(address.query).items()}
        rows = lambda at, n: range(at, min(at + n, self.total))
        if address.path.startswith("/server/api"):
            size, page = int(asked["size"]), int(asked["page"])
            objects = [{"_embedded": {"indexableObject": {"handle": f"10/{k}", "metadata": {"dc.title": [{"value": f"Título {k}"}], "dc.contributor.author": [{"value": "A"}, {"value": ""}]}}}} for k in rows(page * size, size)]
            return json.dumps({"_embedded": {"searchResult": {"_embedded": {"objects": objects}, "page": {"totalElements": self.total}}}}).encode()
        if address.path.endswith("efetch"):
            made = [f'<PubmedArticle><MedlineCitation><PMID Version="1">{i}</PMID><Article><ArticleTitle>On {i}</ArticleTitle></Article></MedlineCitation></PubmedArticle>' for i in asked["id"].split(",")]
            return ("<?xml version='1.0'?>\n<PubmedArticleSet>\n" + "\n".join(made) + "\n</PubmedArticleSet>").encode()
        if address.path.endswith("esearch"):
            return json.dumps({"esearchresult": {"count": str(self.total), "idlist": [str(1000 + k) for k in rows(int(asked["retstart"]), int(asked["retmax"]))]}}).encode()
        size, page = int(asked["pageSize"]), int(asked["page"])
        return json.dumps({"total": self.total, "results": [{"id": f"d{k}", "bibjson": {"title": f"On {k}", "year": "2001"}} for k in rows((page - 1) * size, size)]}).encode()


@pytest.fixture
def library():
    opened = []

    def make(*args, **kwargs):
        opened.append(Library(*args, **kwargs))
        return opened[-1]

    yield make
    for one in opened:
        one.server.shutdown()
        one.server.server_close()


def asked(spark, url, backend="doaj", **options):
    return paged.search(spark, backend, "soil & carbon/nitrogen", url=url, interval=0, pause=0.01, **options)


def test_all_pages_in_order(spark, library):
    """Every page fails in passing before it answers; the rows are whole, in their places, and the same again."""
    source = library(437, failing=lambda address, n: [503, 429][n % 2] if n < 3 else None)
    df = asked(spark, source.url + "/", maxResults=400, pageSize=20, pagesAPartition=3)
    assert df.rdd.getNumPartitions() == 7
    found = sorted((r.seq, json.loads(r["item"])["id"]) for r in df.collect())
    assert found == [(k, f"d{k}") for k in range(400)]
    again = asked(spark, source.url + "/", maxResults=400, pageSize=20, pagesAPartition=5, lanes=2)
    assert sorted((r.seq, json.loads(r["item"])["id"]) for r in again.collect()) == found
    assert any(urllib.parse.quote("soil & carbon/nitrogen", safe="") in path for _, path in source.calls)


def test_fewer_than_asked_and_none(spark, library):
    assert asked(spark, library(7).url + "/", maxResults=50, pageSize=3).count() == 7
    assert asked(spark, library(0).url + "/", maxResults=50).count() == 0
    assert asked(spark, library(9).url + "/", maxResults=0).count() == 0
    assert asked(spark, library(9).url + "/", maxResults=4, pageSize=100).count() == 4


def test_lasting_failures_end_the_search(spark, library):
    refused = library(5, failing=lambda address, n: 403)
    with pytest.raises(Exception, match="403 at try 1"):
        asked(spark, refused.url + "/").collect()
    down = library(5, failing=lambda address, n: 500)
    with pytest.raises(Exception, match="500 at try 3"):
        asked(spark, down.url + "/", tries=3).collect()
    assert len(refused.calls) <= 2 and len(down.calls) <= 6


def test_rate_is_shared(spark, library):
    """Four tasks at a time together keep to the interval, but for how long a call takes."""
    source = library(160)
    df = paged.search(spark, "doaj", "q", url=source.url + "/", maxResults=160, pageSize=5, pagesAPartition=8, lanes=4, interval=0.05)
    assert df.count() == 160
    times = sorted(t for t, _ in source.calls)[1:]
    assert len(times) >= 32
    assert times[-1] - times[0] >= 0.05 * (len(times) - 4) * 0.8


def test_repository(spark, library):
    source = library(23)
    found = paged.as_records(asked(spark, source.url, "dspace", maxResults=100, pageSize=10), "dspace", url=source.url, source_db="REPO").orderBy("seq").collect()
    assert [r.title for r in found] == [f"Título {k}" for k in range(23)]
    assert found[3].record_id == "repo:10/3" and found[3].url == f"{source.url}/handle/10/3" and found[3].authors == ["A"]


def test_records(spark, library):
    found = paged.as_records(asked(spark, library(12).url + "/", pageSize=5), "doaj").orderBy("seq").collect()
    assert [(r.record_id, r.title, r.year, r.source_db) for r in found] == [(f"doaj:d{k}", f"On {k}", 2001, "DOAJ") for k in range(12)]


def test_unknown_backend_or_address(spark):
    for options in ({"backend": "nowhere"}, {"backend": "dspace"}):
        with pytest.raises(ValueError):
            paged.Search(options)


@pytest.mark.parametrize("start,stop", [(0, 0), (0, 1), (0, 250), (7, 250), (199, 200), (40, 60)])
def test_split_covers_the_range(start, stop):
    search = paged.Search({"backend": "doaj", "maxResults": "1000", "pageSize": "20", "pagesAPartition": "2"})
    parts = search.split(start, stop)
    assert [k for p in parts for k in range(p.start, p.stop)] == list(range(start, stop))
    # no page is asked for by two partitions
    assert sum(-(-p.stop // 20) - p.start // 20 for p in parts) == (-(-stop // 20) - start // 20 if stop > start else 0)


def test_ids_then_articles(spark, library, tmp_path):
    """A search of ids, then their articles in calls of seven; both fail in between, and some ids come twice."""
    source = library(61, failing=lambda address, n: 500 if n == 1 else None)
    ids = asked(spark, source.url + "/esearch", "pubmed", maxResults=100, pageSize=20)
    assert ids.count() == 61
    folder = str(tmp_path / "articles")
    paged.fetch_articles(ids.unionAll(ids.limit(5)), folder, url=source.url + "/efetch", interval=0, ids_a_call=7, pause=0.01)
    good, bad = articles.read_articles(spark, folder)
    found = R.pubmed(good)
    assert sorted(r.record_id for r in found.collect()) == sorted(f"pubmed:{1000 + k}" for k in range(61))
    assert bad.count() == 0


def test_stream_follows_the_end(spark, library, tmp_path):
    """Batches have what came since the one before, also after the stream was stopped and begun again."""
    source = library(30, failing=lambda address, n: 503 if n == 1 else None)
    spark.dataSource.register(paged.PagedSearch)

    def run():
        df = spark.readStream.format("paged_search").options(backend="doaj", query="q", url=source.url + "/", maxResults="1000", pageSize="8", interval="0", pause="0.01").load()
        query = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        return sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == list(range(30))
    source.total = 53
    assert run() == list(range(53))
    assert run() == list(range(53))


def test_files_larger_than_a_split(spark, tmp_path):
    """One file over many splits, some articles not well formed: they are counted, the others all read."""
    with open(tmp_path / "all.xml", "w") as out:
        out.write("<?xml version='1.0'?>\n<PubmedArticleSet>\n")
        for k in range(3000):
            broken = "<PMID>" if k % 100 == 7 else ""
            out.write(f'<PubmedArticle><MedlineCitation><PMID Version="1">{k}</PMID>{broken}<Article><ArticleTitle>On {k} &amp; more</ArticleTitle><Abstract><AbstractText Label="A">Aim.</AbstractText><AbstractText>End.</AbstractText></Abstract>')
            out.write('<ELocationID EIdType="doi">10.1/X</ELocationID></Article></MedlineCitation></PubmedArticle>\n' if k % 2 else "</Article></MedlineCitation></PubmedArticle>\n")
        out.write("</PubmedArticleSet>\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        good, bad = articles.read_articles(spark, str(tmp_path))
        assert good.rdd.getNumPartitions() > 4
        found = {r.extra["pmid"]: r for r in R.pubmed(good).where(F.col("extra.pmid").isNotNull()).collect()}
        assert bad.count() == 30
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(int, found)) == [k for k in range(3000) if k % 100 != 7]
    assert found["1"].record_id == "10.1/x" and found["0"].abstract == "Aim. End." and found["0"].title == "On 0 & more"
