"""JSON loaded against rules: every place that breaks a rule is a row, nothing is dropped unsaid, and what is left is sound."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metasift.functions import text as T
from metasift.operators import nested
from metasift.operators.ordered import settled

#: A key within an object, as paths write it.
_KEY = r"(\.[A-Za-z_][A-Za-z0-9_]*|\[\"([^\"\\]|\\.)*\"\])"


@dataclass(frozen=True)
class Rule:
    """What stands at a path, where something does. ``[*]`` is any place of an array, ``.*`` any key of an object; ``""`` is the whole.

    ``required``: each object that would hold it must. ``low`` and ``high`` bound numbers, ends included; ``choices`` are the texts
    allowed; ``filled`` texts hold more than white space; ``least`` is the fewest elements of an array. Whole numbers count as floats.
    """

    path: str
    kinds: tuple[str, ...]
    required: bool = False
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] | None = None
    filled: bool = False
    least: int = 0

    def __post_init__(self) -> None:
        if self.required and not re.search(r"\.[A-Za-z_]\w*$", self.path):
            raise ValueError(f"only a named key can be required: {self.path!r}")

    def at(self, path: Column) -> Column:
        return path.rlike(_pattern(self.path))

    @property
    def above(self) -> str:
        return self.path.rpartition(".")[0]

    @property
    def expected(self) -> str:
        parts = [" or ".join(self.kinds)]
        parts += [f"from {self.low:g}"] if self.low is not None else []
        parts += [f"to {self.high:g}"] if self.high is not None else []
        parts += ["one of " + ", ".join(self.choices)] if self.choices is not None else []
        parts += ["not blank"] if self.filled else []
        parts += [f"{self.least} elements or more"] if self.least else []
        return ", ".join(parts)


def _pattern(path: str) -> str:
    pieces = re.split(r"(\[\*\]|\.\*)", path)
    return "^" + "".join({"[*]": r"\[[0-9]+\]", ".*": _KEY}.get(p) or re.escape(p) for p in pieces) + "$"


LABELS = ("include", "exclude", "unclear")
#: Records of a search.
RECORD = (
    Rule("", ("object",)), Rule(".record_id", ("string",), True), Rule(".title", ("string",), True), Rule(".abstract", ("string", "null")), Rule(".authors", ("array",)), Rule(".authors[*]", ("string",)),
    Rule(".year", ("int", "null")), Rule(".doi", ("string", "null")), Rule(".url", ("string", "null")), Rule(".source_db", ("string",)), Rule(".extra", ("object",)),
)
#: Decisions with their votes.
DECISION = (
    Rule("", ("object",)), Rule(".record_id", ("string",), True), Rule(".phase", ("string",), choices=("title_abstract", "fulltext")), Rule(".votes", ("array",)), Rule(".votes[*]", ("object",)),
    Rule(".votes[*].model", ("string",), True), Rule(".votes[*].label", ("string",), True, choices=LABELS), Rule(".votes[*].confidence", ("float",), True, low=0, high=1),
    Rule(".votes[*].criteria_violated", ("array",)), Rule(".votes[*].criteria_violated[*]", ("string",)),
    *(Rule(f".{name}", ("string", "null"), choices=LABELS) for name in ("ensemble_label", "human_label", "final_label")), Rule(".fulltext_status", ("string", "null"), choices=("retrieved", "not_retrieved")),
)
#: Files of a protocol: labels by record, fields of the extraction form, effects, criteria by dimension.
GOLD = (Rule("", ("object",)), Rule(".gold", ("object",), True), Rule(".gold.*", ("bool",)))
FORM = (Rule("", ("object",)), Rule(".fields", ("array", "null")), Rule(".fields[*]", ("object",)), Rule(".fields[*].key", ("string",), True, filled=True))
EFFECTS = (Rule("", ("object",)), Rule(".measure", ("string",)), Rule(".effects", ("array",), least=2), Rule(".effects[*]", ("object",)), Rule(".effects[*].study_id", ("string",), True))
CRITERIA = (Rule("", ("object",)), Rule(".criteria", ("object", "null")), Rule(".criteria.*", ("object", "array", "string")))


def _faults(rule: Rule) -> Column:
    """Why a value at the rule's path breaks it, else null: the first of kind, range, choice, blank, size that does."""
    kinds = set(rule.kinds) | ({"int"} if "float" in rule.kinds else set())
    text = F.from_json(F.concat(F.lit('{"t":'), F.col("content"), F.lit("}")), "t string")["t"]
    is_text = F.col("kind") == "string"
    fault = F.when(~F.col("kind").isin(*kinds), "kind")
    if rule.low is not None or rule.high is not None:
        low, high = (F.col("number") if bound is None else F.lit(bound) for bound in (rule.low, rule.high))
        fault = fault.when(~F.col("number").between(low, high), "range")
    if rule.choices is not None:
        fault = fault.when(is_text & ~text.isin(*rule.choices), "choice")
    if rule.filled:
        fault = fault.when(is_text & (F.length(T.strip(text)) == 0), "blank")
    return fault.when((F.col("kind") == "array") & (F.col("size") < rule.least), "size") if rule.least else fault


def load(rows: DataFrame, id_col: str, raw_col: str, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """Sound rows, as they came, and violations: id, path, fault, expected, found (a kind, or the value as JSON).

    Faults: ``not JSON`` (also null, empty, a key given twice, or more than a VARIANT holds), ``missing``, ``kind``, ``range``,
    ``choice``, ``blank``, ``size``. All of a row's violations are returned, so a row may have many; a value has at most one a rule.
    Keys without a rule are allowed. Rows are told apart by a number of their own, so null and repeated ids are loaded each for itself.
    Texts are opened whole, whatever their length. An empty table gives two empty ones. Rules are few; they become expressions, not a join.
    """
    keyed = settled(rows.withColumn("row_no_", F.monotonically_increasing_id()))
    parsed = keyed.select("row_no_", F.try_parse_json(F.col(raw_col)).alias("value_"))
    empty = F.lit(None).cast("string")
    found = settled(nested.paths(parsed, "row_no_", "value_"))
    broken = F.array_compact(F.array(*[F.when(rule.at(F.col("path")), F.when(_faults(rule).isNotNull(), F.struct(_faults(rule).alias("fault"), F.lit(rule.expected).alias("expected")))) for rule in rules]))
    shown = F.coalesce("content", "kind")
    wrong = found.select("id", "path", F.explode(broken).alias("b"), shown.alias("found")).select("id", "path", "b.fault", "b.expected", "found")
    unread = parsed.where("value_ IS NULL").select(F.col("row_no_").alias("id"), F.lit("").alias("path"), F.lit("not JSON").alias("fault"), F.lit("JSON").alias("expected"), empty.alias("found"))
    needed = [r for r in rules if r.required]
    out = wrong.unionByName(unread)
    if needed:
        child = lambda r: F.when(F.col("path").rlike(_pattern(r.above)), F.struct(F.concat("path", F.lit(r.path[len(r.above) :])).alias("path"), F.lit(r.expected).alias("expected")))
        wanted = found.where("kind = 'object'").select("id", F.explode(F.array_compact(F.array(*[child(r) for r in needed]))).alias("w")).select("id", "w.*")
        missing = wanted.join(found.select("id", "path"), ["id", "path"], "left_anti")
        out = out.unionByName(missing.select("id", "path", F.lit("missing").alias("fault"), "expected", empty.alias("found")))
    out = settled(out)
    sound = keyed.join(out.select(F.col("id").alias("row_no_")).distinct(), "row_no_", "left_anti").drop("row_no_")
    named = out.join(keyed.select(F.col("row_no_").alias("id"), F.col(id_col).alias("named_")), "id")
    return sound, named.select(F.col("named_").alias("id"), "path", "fault", "expected", "found")


def first_faults(violations: DataFrame) -> DataFrame:
    """For each id the violation that comes first by path, and how many more it has: id, path, fault, n_more."""
    first = F.min(F.struct("path", "fault")).alias("first")
    return violations.groupBy("id").agg(first, (F.count(F.lit(1)) - 1).alias("n_more")).select("id", "first.path", "first.fault", "n_more")


def load_files(spark: SparkSession, folder: str, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """The JSON files of a folder, each one value: sound ones (path, raw) and violations by path of the file."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return load(files, "path", "raw", rules)
