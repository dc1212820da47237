"""Source answers (JSON documents, tagged metadata, text files) as record tables.

Records have record_id, title, abstract, authors, year, doi, url, source_db, extra (a map) and seq, the reading order.
Fetching is left to a caller's plug-in; each mapper starts from a DataFrame of fetched documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metasift.functions import text as T
from metasift.operators.ordered import positions

RECORD = "record_id string, title string, abstract string, authors array<string>, year int, doi string, url string, source_db string, extra map<string,string>"

#: Fixed: database names that share a backend.
ALIASES = {
    "openalex": "openalex",
    "crossref": "crossref",
    "semanticscholar": "semanticscholar", "semantic_scholar": "semanticscholar", "s2": "semanticscholar",
    "europepmc": "europepmc", "europe_pmc": "europepmc", "epmc": "europepmc",
    "pubmed": "pubmed", "medline": "pubmed", "ncbi": "pubmed", "entrez": "pubmed",
    "pmc": "pmc",
    "eric": "eric",
    "doaj": "doaj",
    "unesdoc": "unesdoc", "unesco": "unesdoc",
    "bvs": "bvs", "lilacs": "bvs", "bvsalud": "bvs",
    "gim": "gim", "globalindexmedicus": "gim",
    "agrosavia": "agrosavia",
    "clacso": "clacso",
    "worldbank": "worldbankokr", "worldbankokr": "worldbankokr", "okr": "worldbankokr", "bancomundial": "worldbankokr",
    "doab": "doab",
}
#: Fixed: databases without an open search interface, read from exported files only.
MANUAL_ONLY = (
    "scopus", "webofscience", "wos", "embase", "psycinfo", "redalyc", "dialnet", "scielo", "googlescholar", "scholar", "mendeley", "dynamed", "lens",
    "pedro", "cinahl", "cochrane", "cochranelibrary", "central", "proquest", "econlit", "jstor", "ieeexplore", "acm", "sciencedirect", "ebsco", "ovid",
)


def record(record_id: Column, title: Column, **fields: Column) -> list[Column]:
    """The columns of a record; those that aren't given are null, empty or ``unknown``."""
    empty = {
        "abstract": F.lit(None).cast("string"),
        "authors": F.array().cast("array<string>"),
        "year": F.lit(None).cast("int"),
        "doi": F.lit(None).cast("string"),
        "url": F.lit(None).cast("string"),
        "source_db": F.lit("unknown"),
        "extra": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
    }
    columns = {"record_id": record_id, "title": F.coalesce(T.empty_to_null(title), F.lit(T.MISSING_TITLE))} | empty | fields
    return [c.alias(name) for name, c in columns.items()]


def extras(**values: Column) -> Column:
    """A map of the values that aren't empty."""
    pairs = F.create_map(*[x for key, value in values.items() for x in (F.lit(key), value.cast("string"))])
    return F.map_filter(pairs, lambda _, v: F.coalesce(F.length(v) > 0, F.lit(False)))


def full_names(people: Column, *parts: str) -> Column:
    return F.filter(F.transform(people, lambda p: F.concat_ws(" ", *[T.empty_to_null(p[x]) for x in parts])), lambda name: F.length(name) > 0)


def plain_doi(doi: Column) -> Column:
    return T.empty_to_null(T.strip(F.lower(doi)))


def or_native(doi: Column, prefix: str, native: Column) -> Column:
    return F.coalesce(doi, F.concat(F.lit(prefix + ":"), native.cast("string")))


def abstract_of(index: Column) -> Column:
    """Text from an inverted index (word to places), by place; null where it is empty."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda at: F.struct(at.alias("at"), e["key"].alias("word")))))
    return T.empty_to_null(F.array_join(F.transform(F.array_sort(placed), lambda p: p["word"]), " "))


WORKS = (
    "id string, doi string, title string, publication_year int, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>,"
    " open_access struct<oa_url:string>, primary_location struct<pdf_url:string,landing_page_url:string>"
)


def works(raw: DataFrame) -> DataFrame:
    """General index. DOI, else the last part of the work's id."""
    doi = T.index_doi(F.col("doi"))
    url = F.coalesce("open_access.oa_url", "primary_location.pdf_url", "primary_location.landing_page_url")
    return raw.select(
        "seq",
        *record(
            F.coalesce(doi, F.regexp_extract("id", "[^/]+$", 0)),
            F.col("title"),
            abstract=abstract_of(F.col("abstract_inverted_index")),
            authors=F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: F.length(n) > 0),
            year=F.col("publication_year"),
            doi=doi,
            url=F.col("id"),
            source_db=F.lit("OpenAlex"),
            extra=extras(oa_url=url),
        ),
    )


CROSSREF = "DOI string, title array<string>, abstract string, author array<struct<given:string,family:string>>, issued struct<`date-parts`:array<array<int>>>, URL string"


def crossref(raw: DataFrame) -> DataFrame:
    doi = plain_doi(F.col("DOI"))
    year = F.get(F.get(F.col("issued")["date-parts"], F.lit(0)), F.lit(0))
    native = F.coalesce(F.col("DOI"), F.col("seq").cast("string"))
    return raw.select("seq", *record(or_native(doi, "crossref", native), F.get("title", F.lit(0)), abstract=T.untagged(F.col("abstract")), authors=full_names(F.col("author"), "given", "family"), year=year, doi=doi, url=F.col("URL"), source_db=F.lit("Crossref")))


SEMANTIC = "paperId string, title string, abstract string, year int, externalIds struct<DOI:string>, authors array<struct<name:string>>, url string, openAccessPdf struct<url:string>"


def semantic_scholar(raw: DataFrame) -> DataFrame:
    doi = plain_doi(F.col("externalIds.DOI"))
    return raw.select("seq", *record(or_native(doi, "s2", F.coalesce(F.col("paperId"), F.col("seq").cast("string"))), F.col("title"), abstract=F.col("abstract"), authors=full_names(F.col("authors"), "name"), year=F.col("year"), doi=doi, url=F.col("url"), source_db=F.lit("SemanticScholar"), extra=extras(oa_url=F.col("openAccessPdf.url"))))


EUROPEPMC = "id string, source string, doi string, title string, abstractText string, authorString string, pubYear string"


def europe_pmc(raw: DataFrame) -> DataFrame:
    doi = plain_doi(F.col("doi"))
    native = F.concat(F.coalesce("source", F.lit("EPMC")), F.lit(":"), F.coalesce(F.col("id"), F.col("seq").cast("string")))
    authors = F.filter(F.transform(F.split("authorString", ","), T.strip), lambda a: F.length(a) > 0)
    return raw.select("seq", *record(or_native(doi, "europepmc", native), F.col("title"), abstract=T.untagged(F.col("abstractText")), authors=F.coalesce(authors, F.array().cast("array<string>")), year=F.col("pubYear").try_cast("int"), doi=doi, url=F.concat(F.lit("https://doi.org/"), doi), source_db=F.lit("EuropePMC")))


ERIC = "id string, title string, description string, author array<string>, publicationdateyear string, url string, peerreviewed string"


def eric(raw: DataFrame) -> DataFrame:
    """A DOI only where the address has the resolver in it."""
    doi = F.when(F.contains("url", F.lit("doi.org/")), T.repository_doi(F.col("url")))
    native = F.coalesce(F.col("id"), F.col("seq").cast("string"))
    url = F.coalesce(T.empty_to_null(F.col("url")), F.concat(F.lit("https://eric.ed.gov/?id="), native))
    authors = F.filter(F.coalesce("author", F.array().cast("array<string>")), lambda a: F.length(a) > 0)
    return raw.select("seq", *record(or_native(doi, "eric", native), F.col("title"), abstract=T.untagged(F.col("description")), authors=authors, year=T.leading_year(F.col("publicationdateyear")), doi=doi, url=url, source_db=F.lit("ERIC"), extra=extras(eric_id=native, peer_reviewed=F.col("peerreviewed") == "T")))


DOAJ = (
    "id string, bibjson struct<title:string,abstract:string,year:string,identifier:array<struct<type:string,id:string>>,link:array<struct<type:string,url:string>>,"
    "author:array<struct<name:string>>,journal:struct<title:string,language:array<string>>>"
)


def doaj(raw: DataFrame) -> DataFrame:
    """First identifier of type doi, first link of type fulltext."""
    first = lambda array, kind: F.get(F.filter(array, lambda x: x["type"] == kind), F.lit(0))
    doi, oa_url = T.repository_doi(first("bibjson.identifier", "doi")["id"]), first("bibjson.link", "fulltext")["url"]
    return raw.select(
        "seq",
        *record(or_native(doi, "doaj", F.col("id")), F.col("bibjson.title"), abstract=T.untagged(F.col("bibjson.abstract")), authors=full_names(F.col("bibjson.author"), "name"), year=T.leading_year(F.col("bibjson.year")), doi=doi, url=F.coalesce(F.concat(F.lit("https://doi.org/"), doi), oa_url), source_db=F.lit("DOAJ"), extra=extras(journal=F.col("bibjson.journal.title"), language=F.array_join("bibjson.journal.language", ","), oa_url=oa_url)),
    )


PMC_SUMMARY = "uid string, title string, pubdate string, articleids array<struct<idtype:string,value:string>>, authors array<struct<name:string>>"


def pmc_summaries(raw: DataFrame) -> DataFrame:
    """Summaries by uid; no abstract. Of several identifiers of type doi the last counts."""
    dois = F.filter("articleids", lambda a: F.lower(a["idtype"]) == "doi")
    doi = T.empty_to_null(F.lower(F.try_element_at(dois, F.lit(-1))["value"]))
    pmcid = F.concat(F.lit("PMC"), F.col("uid"))
    year = F.substring("pubdate", 1, 4)
    return raw.select("seq", *record(or_native(doi, "pmc", F.col("uid")), F.col("title"), authors=F.coalesce(full_names(F.col("authors"), "name"), F.array().cast("array<string>")), year=F.when(year.rlike(r"^\d{4}$"), year.try_cast("int")), doi=doi, url=F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), pmcid, F.lit("/")), source_db=F.lit("PMC"), extra=extras(pmcid=pmcid)))


UNESDOC = "uuid string, title string, description string, creator string, year array<string>, url string, language array<string>, document_type string, isbn string"


def unesdoc(raw: DataFrame) -> DataFrame:
    """Grey literature without DOIs."""
    creator = F.filter(F.array("creator"), lambda c: F.length(c) > 0)
    return raw.select("seq", *record(F.concat(F.lit("unesdoc:"), F.coalesce(F.col("uuid"), F.col("seq").cast("string"))), F.col("title"), abstract=T.untagged(F.col("description")), authors=creator, year=T.leading_year(F.get("year", F.lit(0))), url=F.col("url"), source_db=F.lit("UNESDOC"), extra=extras(language=F.array_join("language", ","), document_type=F.col("document_type"), isbn=F.col("isbn"))))


def first_of_list(raw: DataFrame, prefix: str, source_db: str, *, id_col: str, title_col: str, abstract_col: str, author_col: str, date_col: str, url_col: str) -> DataFrame:
    """Portals whose fields are lists: the first title, abstract and address; all authors; no DOI."""
    head = lambda c: F.get(c, F.lit(0))
    return raw.select("seq", *record(F.concat(F.lit(prefix + ":"), F.col(id_col)), head(title_col), abstract=T.untagged(head(abstract_col)), authors=F.coalesce(author_col, F.array().cast("array<string>")), year=T.leading_year(F.col(date_col)), url=head(url_col), source_db=F.lit(source_db)))


def metadata_map(rows: DataFrame, item_col: str, key_col: str, value_col: str, order_col: str) -> DataFrame:
    """Key-value rows to one multimap an item; values keep their order, empty ones go."""
    kept = rows.where(F.length(value_col) > 0)
    lists = kept.groupBy(item_col, key_col).agg(F.transform(F.array_sort(F.collect_list(F.struct(order_col, value_col))), lambda x: x[value_col]).alias("values"))
    return lists.groupBy(item_col).agg(F.map_from_entries(F.collect_list(F.struct(key_col, "values"))).alias("meta"))


def hal_map(metadata: Column) -> Column:
    """``{key: [{value}]}`` to a multimap."""
    return F.transform_values(metadata, lambda _, xs: F.filter(F.transform(xs, lambda x: x["value"]), lambda v: F.length(v) > 0))


def dublin_core(raw: DataFrame, source_db: str, *, native_col: str = "native_id", url_col: str = "url_fallback", meta_col: str = "meta") -> DataFrame:
    """Repository metadata, a multimap of Dublin Core fields."""
    none = F.array().cast("array<string>")
    values = lambda *keys: F.concat(*[F.coalesce(F.try_element_at(F.col(meta_col), F.lit(k)), none) for k in keys])
    first = lambda *keys: F.get(values(*keys), F.lit(0))
    doi = F.get(F.filter(F.transform(values("dc.identifier.doi", "dc.identifier", "dc.identifier.uri"), T.repository_doi), lambda d: d.isNotNull()), F.lit(0))
    authors = values("dc.contributor.author")
    authors = F.when(F.size(authors) > 0, authors).otherwise(values("dc.creator"))
    titles = values("dc.title")
    return raw.select(
        "seq",
        *record(or_native(doi, source_db.lower(), F.col(native_col)), F.get(titles, F.lit(0)), abstract=T.untagged(first("dc.description.abstract")), authors=authors, year=T.leading_year(first("dc.date.issued")), doi=doi, url=F.coalesce(first("dc.identifier.uri"), F.col(url_col)), source_db=F.lit(source_db), extra=extras(titles=F.array_join(F.slice(titles, 2, 1 << 20), "; "), language=F.array_join(values("dc.language.iso", "dc.language"), ","), isbn=F.array_join(values("dc.identifier.isbn"), ","), oa_url=first("okr.pdfurl"))),
    )


PUBMED = (
    "PMID string, ArticleTitle string, Abstract struct<AbstractText:array<string>>, AuthorList struct<Author:array<struct<ForeName:string,LastName:string>>>,"
    " PubDate struct<Year:string,MedlineDate:string>, ArticleIdList struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>, ELocationID array<struct<_EIdType:string,_VALUE:string>>"
)


def pubmed(raw: DataFrame) -> DataFrame:
    """Article rows of PUBMED (read with the XML source, or from_xml). The year, else the first four characters of the free date."""
    of_kind = lambda array, field, kind: F.get(F.filter(array, lambda x: (F.lower(x[field]) == kind) & (F.length(T.strip(x["_VALUE"])) > 0)), F.lit(0))["_VALUE"]
    ids = F.col("ArticleIdList.ArticleId")
    doi = F.coalesce(plain_doi(of_kind(ids, "_IdType", "doi")), plain_doi(of_kind(F.col("ELocationID"), "_EIdType", "doi")))
    pmid = T.empty_to_null(T.strip(F.col("PMID")))
    digits = lambda c: F.when(c.rlike(r"^\d+$"), c.try_cast("int"))
    year = F.coalesce(digits(F.col("PubDate.Year")), digits(F.substring("PubDate.MedlineDate", 1, 4)))
    title = F.coalesce(T.empty_to_null(F.col("ArticleTitle")), F.lit(T.MISSING_TITLE))
    parts = F.filter(F.transform("Abstract.AbstractText", T.strip), lambda p: F.length(p) > 0)
    url = F.coalesce(F.concat(F.lit("https://doi.org/"), doi), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")))
    return raw.select("seq", *record(F.coalesce(doi, F.concat(F.lit("pubmed:"), F.coalesce(pmid, F.substring(title, 1, 40)))), title, abstract=T.empty_to_null(F.array_join(parts, " ")), authors=F.coalesce(full_names(F.col("AuthorList.Author"), "ForeName", "LastName"), F.array().cast("array<string>")), year=year, doi=doi, url=url, source_db=F.lit("PubMed"), extra=extras(pmid=pmid, pmcid=T.strip(of_kind(ids, "_IdType", "pmc")))))


def passages_text(documents: Column) -> Column:
    """Full text of an annotated article: its passages that aren't blank, a blank line between them."""
    texts = F.flatten(F.transform(documents, lambda d: F.transform(d["passages"], lambda p: p["text"])))
    return T.empty_to_null(F.array_join(F.filter(texts, lambda t: F.length(T.strip(t)) > 0), "\n\n"))


def id_lookup(converted: DataFrame) -> DataFrame:
    """(doi, pmid, pmcid) rows to a table from any of the three, lower case, to the pmcid."""
    keys = F.explode(F.array_distinct(F.filter(F.array(F.lower("doi"), F.lower("pmid"), F.lower("pmcid")), lambda k: F.length(k) > 0)))
    return converted.where(F.length("pmcid") > 0).select(keys.alias("key"), "pmcid").groupBy("key").agg(F.min("pmcid").alias("pmcid"))


def with_pmcid(records: DataFrame, lookup: DataFrame) -> DataFrame:
    """``pmcid``: the record's own, else by its pmid, else by its doi."""
    own, key = F.try_element_at("extra", F.lit("pmcid")), F.lower(F.coalesce(F.try_element_at("extra", F.lit("pmid")), F.col("doi")))
    found = lookup.select(F.col("key").alias("lookup_key"), F.col("pmcid").alias("found"))
    return records.join(found, key == found["lookup_key"], "left").withColumn("pmcid", F.coalesce(own, "found")).drop("lookup_key", "found")


def open_url(records: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """``open_url``: the record's full-text address, else its open-access one, else a looked-up one (doi, url)."""
    own = [F.try_element_at("extra", F.lit(k)) for k in ("fulltext_url", "oa_url")]
    if lookup is None:
        return records.withColumn("open_url", F.coalesce(*own))
    found = lookup.select(F.col("doi").alias("lookup_doi"), F.col("url").alias("found"))
    return records.join(found, records["doi"] == found["lookup_doi"], "left").withColumn("open_url", F.coalesce(*own, "found")).drop("lookup_doi", "found")


def in_order(parts: list[DataFrame]) -> DataFrame:
    """Sources one after another; ``seq`` runs over all of them. Each part's own ``seq`` orders it."""
    numbered = [part.withColumn("source_no", F.lit(i)) for i, part in enumerate(parts)]
    together = reduce(lambda a, b: a.unionByName(b), numbered)
    return together.withColumn("seq", F.struct("source_no", "seq")).drop("source_no")


def dense_seq(records: DataFrame) -> DataFrame:
    """``seq`` as a whole number from 1 in the same order."""
    return positions(records, "seq").withColumn("seq", F.col("pos") + 1).drop("pos", "n")


def backend_of(names: DataFrame, name_col: str) -> DataFrame:
    """``backend`` of a database name, and ``kind``: database, manual or unknown."""
    spark = names.sparkSession
    table = spark.createDataFrame([*ALIASES.items(), *((m, None) for m in MANUAL_ONLY)], "alias string, backend string")
    joined = names.join(F.broadcast(table), T.database_key(F.col(name_col)) == table["alias"], "left")
    kind = F.when(F.col("backend").isNotNull(), "database").when(F.col("alias").isNotNull(), "manual").otherwise("unknown")
    return joined.withColumn("kind", kind).drop("alias")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """RIS and BibTeX files of a folder, by path: path, suffix, text (bytes that aren't UTF-8 give null and ``readable`` false)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{ris,bib,bibtex,RIS,BIB,BIBTEX}").load(folder)
    text = F.try_validate_utf8(files["content"].cast("string"))
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("suffix"), text.alias("text"), text.isNotNull().alias("readable"))


def parse_ris(files: DataFrame, source_db: str = "imported-RIS") -> DataFrame:
    """(path, text) to records. A record ends at its ER line or with the file; the first title, abstract, DOI, year and address count, and all authors."""
    lines = files.select("path", F.posexplode(F.split("text", r"\r\n|\n|\r", -1)).alias("line", "raw"))
    tagged = lines.select("path", "line", F.regexp_extract("raw", r"^([A-Z][A-Z0-9])  - ?(.*)$", 1).alias("tag"), T.strip(F.regexp_extract("raw", r"^([A-Z][A-Z0-9])  - ?(.*)$", 2)).alias("value")).where("tag <> ''")
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    numbered = tagged.withColumn("rec", F.coalesce(F.sum((F.col("tag") == "ER").cast("int")).over(before), F.lit(0))).where("tag <> 'ER'")
    values = F.array_sort(F.collect_list(F.struct("line", "tag", "value")))
    grouped = numbered.groupBy("path", "rec").agg(values.alias("fields"))
    all_of = lambda tag: F.transform(F.filter("fields", lambda f: f["tag"] == tag), lambda f: f["value"])
    first = lambda *tags: F.coalesce(*[F.get(all_of(t), F.lit(0)) for t in tags])
    doi, title = first("DO"), F.coalesce(first("TI", "T1"), F.lit(T.MISSING_TITLE))
    return grouped.select(F.struct("path", "rec").alias("seq"), *record(T.import_id(doi, title), title, abstract=first("AB"), authors=all_of("AU"), year=T.any_year(first("PY", "Y1")), doi=plain_doi(doi), url=first("UR"), source_db=F.lit(source_db)))


def parse_bibtex(files: DataFrame, source_db: str = "imported-BibTeX") -> DataFrame:
    """(path, text) to records. An entry ends before the next @ sign; values stand in braces (one level) or quotes; the last value of a field counts."""
    entries = files.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r"@\w+\s*\{([^@]*)"), F.lit(1))).alias("rec", "body"))
    pattern = r"""(\w+)\s*=\s*(?:\{([^{}]*)\}|"([^"]*)")"""
    part = lambda k: F.regexp_extract_all("body", F.lit(pattern), F.lit(k))
    # of a pair of groups the one that didn't match is empty
    found = F.zip_with(part(1), F.zip_with(part(2), part(3), lambda a, b: F.concat(a, b)), lambda k, v: F.struct(F.lower(k).alias("key"), T.one_space(v).alias("value")))
    listed = entries.select("path", "rec", found.alias("fields")).where(F.size("fields") > 0)
    field = lambda key: F.try_element_at(F.transform(F.filter("fields", lambda f: f["key"] == key), lambda f: f["value"]), F.lit(-1))
    doi, title = field("doi"), F.coalesce(field("title"), F.lit(T.MISSING_TITLE))
    authors = F.filter(F.transform(F.split(F.coalesce(field("author"), F.lit("")), r"\s+and\s+"), T.strip), lambda a: F.length(a) > 0)
    return listed.select(F.struct("path", "rec").alias("seq"), *record(T.import_id(doi, title), title, abstract=field("abstract"), authors=authors, year=T.any_year(field("year")), doi=plain_doi(doi), url=field("url"), source_db=F.lit(source_db)))


def import_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Records of all readable files by path, and the paths of unreadable ones."""
    files = read_files(spark, folder)
    good = files.where("readable")
    records = parse_ris(good.where("suffix = 'ris'")).unionByName(parse_bibtex(good.where("suffix IN ('bib', 'bibtex')")))
    return records, files.where("NOT readable").select("path")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with their line number; ``status``: ok, torn (the last line, without its line end: to be ignored) or bad."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\n", -1)).alias("pos", "raw"), F.size(F.split("value", "\n", -1)).alias("n"))
    kept = lines.where("raw <> ''").select((F.col("pos") + 1).alias("line_no"), "raw", (F.col("pos") == F.col("n") - 1).alias("open"))
    parsed = kept.withColumn("row", F.from_json("raw", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    status = F.when(F.col("row._bad").isNull(), "ok").when(F.col("open"), "torn").otherwise("bad")
    return parsed.select("line_no", "raw", status.alias("status"), "row.*").drop("_bad")
