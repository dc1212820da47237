"""Paged search interfaces as a Spark data source, for batches and streams, and articles fetched by their ids.

    spark.dataSource.register(paged.PagedSearch)
    spark.read.format("paged_search").options(backend="doaj", query="soil AND carbon", maxResults=5000).load()

A search's pages are dealt to partitions, so tasks fetch at the same time. Rows have their place in the search, so a task
that runs again gives the same rows. Calls are spaced over all tasks together: of ``lanes`` tasks that may run at a time each keeps
``lanes`` times the interval. A call that fails in passing (no connection, too many calls, a fault of the server) is tried again after
a growing pause, or the one the server asks for; any other failure, and the last try, ends the task with its address.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from metasift.sources import records as R

Answer = dict


def within(value: object, *path: str) -> object:
    """A value inside nested objects, or None where the way there ends."""
    for key in path:
        value = value.get(key) if isinstance(value, dict) else None
    return value


@dataclass(frozen=True)
class Dialect:
    """How a search interface is asked and answers. ``ask``: query, first row, rows a page -> parameters (or path and parameters)."""

    url: str
    largest_page: int
    ask: Callable[[str, int, int], dict[str, object]]
    total: tuple[str, ...]
    items: tuple[str, ...]
    #: Seconds between two calls.
    interval: float = 0.0
    #: Part of the address that the query makes, after ``url``.
    path: Callable[[str], str] = lambda query: ""
    #: Where an item lies within what the list holds.
    inner: tuple[str, ...] = ()


#: Addresses, parameters and limits of public search interfaces.
DIALECTS = {
    "openalex": Dialect("https://api.openalex.org/works", 200, lambda q, at, n: {"search": q, "per-page": n, "page": at // n + 1}, ("meta", "count"), ("results",)),
    "crossref": Dialect("https://api.crossref.org/works", 1000, lambda q, at, n: {"query": q, "rows": n, "offset": at}, ("message", "total-results"), ("message", "items")),
    "semanticscholar": Dialect("https://api.semanticscholar.org/graph/v1/paper/search", 100, lambda q, at, n: {"query": q, "limit": n, "offset": at, "fields": "title,abstract,year,externalIds,authors,url,openAccessPdf"}, ("total",), ("data",), 1.0),
    "eric": Dialect("https://api.ies.ed.gov/eric/", 200, lambda q, at, n: {"search": q, "rows": n, "start": at, "format": "json"}, ("response", "numFound"), ("response", "docs")),
    "doaj": Dialect("https://doaj.org/api/search/articles/", 100, lambda q, at, n: {"page": at // n + 1, "pageSize": n}, ("total",), ("results",), 0.5, lambda q: urllib.parse.quote(q, safe="")),
    "dspace": Dialect("", 100, lambda q, at, n: {"query": q, "dsoType": "item", "page": at // n, "size": n}, ("_embedded", "searchResult", "page", "totalElements"), ("_embedded", "searchResult", "_embedded", "objects"), 0.0, lambda q: "/server/api/discover/search/objects", ("_embedded", "indexableObject")),
    "pubmed": Dialect("https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi", 10_000, lambda q, at, n: {"db": "pubmed", "term": q, "retmode": "json", "retstart": at, "retmax": n}, ("esearchresult", "count"), ("esearchresult", "idlist"), 0.34),
    "pmc": Dialect("https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi", 10_000, lambda q, at, n: {"db": "pmc", "term": q, "retmode": "json", "retstart": at, "retmax": n}, ("esearchresult", "count"), ("esearchresult", "idlist"), 0.34),
}
ARTICLES_URL = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi"
#: Seconds between two calls with a key, and how many ids one call may ask for.
KEYED_INTERVAL, IDS_A_CALL = 0.11, 200

SCHEMA = "backend string, query string, seq long, item string"
PASSING = {408, 425, 429, 500, 502, 503, 504}


class Caller:
    """Calls of one task: spaced, and tried again when they fail in passing."""

    def __init__(self, interval: float, lane: int = 0, lanes: int = 1, tries: int = 6, pause: float = 0.5, timeout: float = 60.0):
        self.gap, self.tries, self.pause, self.timeout = interval * lanes, tries, pause, timeout
        # tasks that start together don't call together
        self.next_at = time.monotonic() + interval * lane

    def get(self, url: str, params: dict[str, object]) -> bytes:
        address = f"{url}?{urllib.parse.urlencode(params)}"
        for n in range(1, self.tries + 1):
            time.sleep(max(self.next_at - time.monotonic(), 0))
            self.next_at = time.monotonic() + self.gap
            asked = None
            try:
                with urllib.request.urlopen(address, timeout=self.timeout) as answer:
                    return answer.read()
            except urllib.error.HTTPError as failure:
                if failure.code not in PASSING or n == self.tries:
                    raise RuntimeError(f"{address}: {failure.code} at try {n}") from failure
                asked = failure.headers.get("Retry-After", "")
            except (urllib.error.URLError, TimeoutError, ConnectionError) as failure:
                if n == self.tries:
                    raise RuntimeError(f"{address}: {failure} at try {n}") from failure
            wait = float(asked) if asked and asked.replace(".", "", 1).isdigit() else self.pause * 2 ** (n - 1)
            self.next_at = max(self.next_at, time.monotonic() + wait)
        raise AssertionError("unreachable")


@dataclass
class Pages(InputPartition):
    """Rows ``start`` to before ``stop`` of a search, and which of the lanes fetches them."""

    start: int
    stop: int
    lane: int


class Search:
    """One search, from its options."""

    def __init__(self, options: dict[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        self.backend = given.get("backend", "")
        if self.backend not in DIALECTS:
            raise ValueError(f"backend is one of {', '.join(DIALECTS)}")
        self.dialect, self.query = DIALECTS[self.backend], given.get("query", "")
        self.url = given.get("url", self.dialect.url)
        if not self.url:
            raise ValueError(f"{self.backend} has no address of its own: give url")
        self.url = self.url.rstrip("/") + "/" if self.url.endswith("/") else self.url
        self.most = int(given.get("maxresults", 25))
        self.size = max(1, min(int(given.get("pagesize", self.dialect.largest_page)), self.dialect.largest_page, max(self.most, 1)))
        self.pages = max(1, int(given.get("pagesapartition", 4)))
        self.lanes = max(1, int(given.get("lanes", 4)))
        self.extra = {k: given[o] for o, k in (("mailto", "mailto" if self.backend not in ("pubmed", "pmc") else "email"), ("key", "api_key")) if given.get(o)}
        usual = KEYED_INTERVAL if self.backend in ("pubmed", "pmc") and given.get("key") else self.dialect.interval
        self.interval = float(given.get("interval", usual))
        self.tries, self.pause = int(given.get("tries", 6)), float(given.get("pause", 0.5))

    def caller(self, lane: int = 0, lanes: int = 1) -> Caller:
        return Caller(self.interval, lane, lanes, self.tries, self.pause)

    def ask(self, caller: Caller, at: int) -> Answer:
        return json.loads(caller.get(self.url + self.dialect.path(self.query), self.dialect.ask(self.query, at, self.size) | self.extra))

    def known(self) -> int:
        """Rows that the search has now, of those wanted."""
        if self.most <= 0:
            return 0
        answer = self.ask(self.caller(), 0)
        total = within(answer, *self.dialect.total)
        return min(self.most, int(total)) if total is not None else min(self.most, len(within(answer, *self.dialect.items) or []))

    def split(self, start: int, stop: int) -> list[Pages]:
        """Rows in partitions of whole pages, the first and last cut where the range begins and ends."""
        first, step = start // self.size * self.size, self.size * self.pages
        cuts = [start, *range(first + step, stop, step), stop] if stop > start else []
        lanes = min(self.lanes, max(len(cuts) - 1, 1))
        return [Pages(a, b, n % lanes) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]

    def rows(self, part: Pages) -> Iterator[tuple]:
        caller = self.caller(part.lane, self.lanes)
        at = part.start // self.size * self.size
        while at < part.stop:
            items = within(self.ask(caller, at), *self.dialect.items) or []
            for k, item in enumerate(items[: self.size], at):
                if part.start <= k < part.stop:
                    inner = within(item, *self.dialect.inner) if self.dialect.inner else item
                    yield self.backend, self.query, k, inner if isinstance(inner, str) else json.dumps(inner, ensure_ascii=False)
            if not items:
                return
            at += self.size


class BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.search = Search(options)

    def partitions(self) -> list[Pages]:
        # a search without rows still has a partition, which reads none
        return self.search.split(0, self.search.known()) or [Pages(0, 0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.search.rows(partition)


class StreamReader(DataSourceStreamReader):
    """Each batch has the rows that came to the end of the search since the one before; offsets are numbers of rows."""

    def __init__(self, options: dict[str, str]):
        self.search = Search(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"rows": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"rows": self.search.known()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.search.split(start["rows"], end["rows"])

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.search.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept at the other end."""


class PagedSearch(DataSource):
    """``backend``, ``query``, ``seq`` (place in the search, from 0) and ``item`` (its JSON, or the id alone).

    Options: backend, query, url (of a mirror, or of a repository without an address of its own), maxResults (25), pageSize,
    pagesAPartition (4), lanes (4), interval (seconds), tries (6), pause (seconds), mailto, key.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(dict(self.options))


#: What an item holds, and the record it becomes.
MAPPERS = {"openalex": (R.WORKS, R.works), "crossref": (R.CROSSREF, R.crossref), "semanticscholar": (R.SEMANTIC, R.semantic_scholar), "eric": (R.ERIC, R.eric), "doaj": (R.DOAJ, R.doaj)}
DSPACE_ITEM = "handle string, uuid string, metadata map<string,array<struct<value:string>>>"


def as_records(items: DataFrame, backend: str, *, url: str = "", source_db: str = "") -> DataFrame:
    """Rows of the data source as records. A repository's address and name are its own, so they must be given."""
    if backend == "dspace":
        found = items.select("seq", F.from_json("item", DSPACE_ITEM).alias("of")).select("seq", "of.*")
        native = F.coalesce(F.nullif("handle", F.lit("")), "uuid", F.col("seq").cast("string"))
        return R.dublin_core(found.select("seq", native.alias("native_id"), F.concat(F.lit(url.rstrip("/") + "/handle/"), native).alias("url_fallback"), R.hal_map(F.coalesce("metadata", F.create_map().cast("map<string,array<struct<value:string>>>"))).alias("meta")), source_db)
    schema, mapper = MAPPERS[backend]
    return mapper(items.select("seq", F.from_json("item", schema).alias("of")).select("seq", "of.*"))


def search(spark: SparkSession, backend: str, query: str, **options: object) -> DataFrame:
    """A search as rows of the data source."""
    spark.dataSource.register(PagedSearch)
    return spark.read.format("paged_search").options(backend=backend, query=query, **{k: str(v) for k, v in options.items()}).load()


def fetch_articles(ids: DataFrame, folder: str, *, id_col: str = "item", url: str = ARTICLES_URL, lanes: int = 3, interval: float = 0.34, ids_a_call: int = IDS_A_CALL, tries: int = 6, pause: float = 0.5, extra: dict[str, str] | None = None) -> None:
    """The articles of ``ids`` as XML files in ``folder``, an answer a line or more; ``articles.read_articles`` reads them.

    A lane is a partition: it asks for its ids some hundred at a time. Null ids are left out, repeated ones asked for once.
    """

    def fetch(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = Caller(interval, TaskContext.get().partitionId(), lanes, tries, pause)
        waiting: list[str] = []

        def ask(some: list[str]) -> pa.RecordBatch:
            params = {"db": "pubmed", "id": ",".join(some), "retmode": "xml", "rettype": "abstract"} | (extra or {})
            return pa.RecordBatch.from_arrays([pa.array([caller.get(url, params).decode("utf-8", "replace")])], ["value"])

        for batch in stream:
            waiting += batch.column(0).to_pylist()
            while len(waiting) >= ids_a_call:
                yield ask(waiting[:ids_a_call])
                del waiting[:ids_a_call]
        if waiting:
            yield ask(waiting)

    wanted = ids.select(F.col(id_col).cast("string").alias("id")).where("id IS NOT NULL").distinct()
    wanted.repartition(lanes, "id").mapInArrow(fetch, "value string").write.mode("overwrite").text(folder)
