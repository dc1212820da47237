"""Text, identifier and date expressions for bibliographic records. All are Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that Python's str.strip() removes and Spark's trim() doesn't.
EDGE_SPACE = r"(?U)^\s+|\s+$"
MISSING_TITLE = "(sin título)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


def empty_to_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def one_space(c: Column) -> Column:
    """White space of any kind collapsed, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def title_key(title: Column) -> Column:
    """Lower case; anything but a-z and 0-9 separates. A title without such characters has the empty key."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def dedup_key(doi: Column, title: Column) -> Column:
    return F.when(F.length(doi) > 0, F.concat(F.lit("doi:"), strip(F.lower(doi)))).otherwise(F.concat(F.lit("title:"), title_key(title)))


def index_doi(doi: Column) -> Column:
    """DOI as the general index gives it: its resolver removed wherever it stands, lower case."""
    return empty_to_null(strip(F.lower(F.replace(doi, F.lit("https://doi.org/"), F.lit("")))))


#: Fixed order; each prefix is removed once at most. http://dx.doi.org/ isn't among them.
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "doi:")


def repository_doi(value: Column) -> Column:
    """DOI from a repository field, or null where what is left doesn't begin with 10."""
    text = strip(value)
    for prefix in DOI_PREFIXES:
        text = F.regexp_replace(text, f"(?i)^{prefix.replace('.', '[.]')}", "")
    text = strip(F.lower(text))
    return F.when(text.startswith("10."), text)


def leading_year(value: Column) -> Column:
    """The first four characters as a number."""
    return F.substring(strip(value.cast("string")), 1, 4).try_cast("int")


def any_year(value: Column) -> Column:
    """The first four digits in a row."""
    return empty_to_null(F.regexp_extract(value, r"\d{4}", 0)).try_cast("int")


def import_id(doi: Column, title: Column) -> Column:
    """DOI without its resolver, else a hash of the title."""
    bare = strip(F.replace(F.lower(doi), F.lit("https://doi.org/"), F.lit("")))
    return F.when(F.length(doi) > 0, bare).otherwise(F.concat(F.lit("hash:"), F.substring(F.sha2(F.lower(strip(title)), 256), 1, 16)))


def page_text(html: Column) -> Column:
    """Text of a page: scripts and styles dropped, tags to spaces, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return one_space(F.regexp_replace(bare, "(?s)<[^>]+>", " "))


def untagged(text: Column) -> Column:
    """Tags removed without a space; null where nothing is left."""
    return empty_to_null(strip(F.regexp_replace(text, "<[^>]+>", "")))


#: Fixed patterns, applied in this order.
REDACTIONS = (
    (r"""(?i)((?:api-key|authorization)['"]?\s*[:=]\s*)(?<q>['"])[^'"\r\n]*\k<q>""", "$1$2<redacted>$2"),
    (r"""(?i)((?:api-key|authorization)['"]?\s*[:=]\s*)(?!['"]?<redacted>)['"]?(?:(?:bearer|basic|digest|token)\s+)?[^\s'",;}&]+""", "$1<redacted>"),
    (r"(?i)\b(bearer\s+)[A-Za-z0-9._~+/=-]+", "$1<redacted>"),
    (r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{16,}", "<redacted>"),
    (r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}", "<redacted>"),
    (r"(?<![A-Za-z0-9])hf_[A-Za-z0-9]{30,}", "<redacted>"),
    (r"""(//)[^/\s:@'"]+:[^/\s@'"]+@""", "$1<redacted>@"),
    (r"""(?i)((?:api_key|apikey|key|token|access_token|mailto|email|x-amz-signature|x-amz-credential|x-amz-security-token|signature|policy|key-pair-id|sig|client_secret|secret|password)=)[^&\s'"]+""", "$1<redacted>"),
)


def redact(text: Column) -> Column:
    for pattern, replacement in REDACTIONS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def plain(text: Column) -> Column:
    """Format characters dropped, other unprintable ones and white space to single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\p{Cf}", ""), r"[\p{C}\p{Z}]+", " "))


def is_human(actor: Column) -> Column:
    """``human:`` and a visible name."""
    return actor.startswith("human:") & (F.length(plain(F.substring(actor, 7, 1 << 30))) > 0)


def compared_value(value: Column) -> Column:
    """An extracted value as it is compared: lower case, single spaces, blank as null."""
    return empty_to_null(one_space(F.lower(value)))


def citations(text: Column) -> Column:
    """Ids in square brackets, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\[([A-Za-z0-9][\w.:/\-]*)\]"), F.lit(1)))


def claim_context(text: Column, cited: Column, window: int = 120) -> Column:
    """The text around the first ``[cited]``; the token alone where it isn't in the text."""
    token = F.concat(F.lit("["), cited, F.lit("]"))
    at = F.position(token, text)
    begin = F.greatest(F.lit(1), at - window)
    end = at + F.length(token) + window
    return F.when(at > 0, strip(F.substr(text, begin, end - begin))).otherwise(token)


def has_zone(value: Column) -> Column:
    return value.rlike(r"(Z|[+-]\d\d:?\d\d)$")


def zoned_timestamp(value: Column) -> Column:
    """ISO timestamp with an offset; one without is null."""
    return F.when(has_zone(value), F.try_to_timestamp(value))


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a.try_cast("date"), b.try_cast("date")))


def database_key(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit(""))


def model_candidates(model: Column) -> Column:
    """The model's last path segment, then the same without its tag."""
    last = F.element_at(F.split(F.lower(strip(model)), "/"), -1)
    return F.array_distinct(F.array(last, F.substring_index(last, ":", 1)))


def cite_key(record_id: Column) -> Column:
    """Anything but letters and digits to underscores, none at the ends."""
    bare = F.regexp_replace(F.regexp_replace(record_id, r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")
    return F.when(F.length(bare) > 0, bare).otherwise("ref")


def short(text: Column, limit: int = 120) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def list_label(label: Column) -> Column:
    """A label without the separators of a ``label, n; label, n`` list."""
    return plain(F.regexp_replace(label, "[;,]", " - "))


def json_object(text: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def readable(binary: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(binary.cast("string"))


def canonical_map(entries: Column) -> Column:
    """A map of strings as JSON with sorted keys and no spaces."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))), {"ignoreNullFields": "false"})


def canonical_sha256(entries: Column) -> Column:
    return F.sha2(canonical_map(entries), 256)


def numeric_order(value: Column) -> Column:
    """A sorting key: numbers by value first, then the rest by text."""
    number = value.try_cast("long")
    return F.struct(number.isNull(), number, value)
