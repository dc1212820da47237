"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to); only the patterns' sizes reach the
driver. There, words flow from patterns to sources up to each source's target. A pattern's first use costs nothing, each
repetition more than the one before, so nothing is repeated that needn't be. The flow through a pattern says how often its
documents are taken; the seeded order of the documents decides which of them get the last, incomplete round.

A path from the flow's start enters a pattern by one round's edge and pays nothing after that, so the cheapest flow is one
largest flow after another: with first uses alone, then with the first repetition as well, each from what the one before
left. A largest flow is found among the sources, which are few, however many patterns there are: sources take what they
lack one after another, and where words of a pattern are left over while others lack some, words move between sources
of the same patterns, along shortest paths from a source with too much to one with too little. A step of such a path moves
words of many patterns at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metasift.llm.common import settle
from metasift.operators.ordered import earlier, in_ranges

#: Fixed by the query's contract.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Parts of the seeded order; the part where a pattern's last round ends is ordered document by document.
PARTS = 4096

Source = str | None
Pattern = tuple[Source, ...]


def in_order(sources) -> list[Source]:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def share_targets(sizes: dict[Source, int], total: float, weights: tuple[float, ...] = WEIGHTS, most: float = 2.0) -> dict[Source, float]:
    """``total`` shared by weight; no target above ``most`` times its source's size, the excess shared again by weight among the rest."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(in_order(sizes))}
    targets, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        left = total - sum(t for s, t in targets.items() if s not in open_)
        whole = sum(weight[s] for s in in_order(open_))
        share = {s: left * weight[s] / whole for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        targets |= {s: float(most * sizes[s]) for s in full} if full else share
        open_ = open_ - full if full else set()
    return targets


class Flow:
    """Words of each pattern on each of its sources. ``starts`` and ``sources``: pattern p has sources[starts[p] : starts[p + 1]]."""

    def __init__(self, starts: np.ndarray, sources: np.ndarray, sizes: np.ndarray, quotas: np.ndarray):
        self.sizes, self.quotas = sizes, quotas
        owner = np.repeat(np.arange(len(sizes)), np.diff(starts))
        # a pattern's edges by source, so that each source's lie together
        order = np.argsort(sources, kind="stable")
        self.pattern, self.source = owner[order], sources[order]
        self.of_source = np.searchsorted(self.source, np.arange(len(quotas) + 1))
        self.edge_of_pattern = np.argsort(self.pattern, kind="stable")
        self.starts = starts
        self.words = np.zeros(len(sources), np.int64)
        self.inflow = np.zeros(len(quotas), np.int64)

    def edges(self, source: int) -> slice:
        return slice(self.of_source[source], self.of_source[source + 1])

    def reached_from(self, source: int) -> np.ndarray:
        """Sources that words on ``source`` could move to."""
        own = self.edges(source)
        moving = self.pattern[own][self.words[own] > 0]
        lengths = np.diff(self.starts)[moving]
        at = np.repeat(self.starts[moving] - np.concatenate([[0], lengths.cumsum()[:-1]]), lengths) + np.arange(lengths.sum()) if len(moving) else np.zeros(0, np.int64)
        return np.unique(self.source[self.edge_of_pattern[at]])

    def shared(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges to ``a`` with words on them, and those of the same patterns to ``b``."""
        one, other = self.edges(a), self.edges(b)
        _, i, j = np.intersect1d(self.pattern[one], self.pattern[other], assume_unique=True, return_indices=True)
        used = self.words[one][i] > 0
        return i[used] + one.start, j[used] + other.start

    def move(self, a: int, b: int, amount: int) -> None:
        from_, to = self.shared(a, b)
        held = self.words[from_]
        part = np.clip(amount - (held.cumsum() - held), 0, held)
        self.words[from_] -= part
        self.words[to] += part

    def path(self) -> list[int] | None:
        """Sources from one with too much to one with too little, the fewest steps; None where there's no such way."""
        via: dict[int, int | None] = dict.fromkeys(np.flatnonzero(self.inflow > self.quotas).tolist())
        level = list(via)
        while level:
            below = []
            for s in level:
                for t in self.reached.setdefault(s, self.reached_from(s)).tolist():
                    if t not in via:
                        via[t] = s
                        if self.inflow[t] < self.quotas[t]:
                            way = [t]
                            while (back := via[way[-1]]) is not None:
                                way.append(back)
                            return way[::-1]
                        below.append(t)
            level = below
        return None

    def add_round(self) -> np.ndarray:
        """Words that one more use of every pattern adds to the largest flow, by pattern."""
        before = np.bincount(self.pattern, self.words, len(self.sizes)).astype(np.int64)
        # each source in turn takes what it lacks from its patterns' new words; what nobody takes begins on the pattern's first source
        new = np.where(np.diff(self.starts) > 0, self.sizes, 0)
        for s in range(len(self.quotas)):
            own = self.edges(s)
            free = new[self.pattern[own]]
            part = np.clip(max(self.quotas[s] - self.inflow[s], 0) - (free.cumsum() - free), 0, free)
            self.words[own] += part
            new[self.pattern[own]] -= part
            self.inflow[s] += part.sum()
        left = np.flatnonzero(new)
        first = self.edge_of_pattern[self.starts[left]]
        self.words[first] += new[left]
        np.add.at(self.inflow, self.source[first], new[left])
        self.reached: dict[int, np.ndarray] = {}
        while (way := self.path()) is not None:
            steps = list(zip(way, way[1:], strict=False))
            room = min(int(self.words[self.shared(a, b)[0]].sum()) for a, b in steps)
            amount = int(min(room, self.inflow[way[0]] - self.quotas[way[0]], self.quotas[way[-1]] - self.inflow[way[-1]]))
            for a, b in steps:
                self.move(a, b, amount)
            self.inflow[way[0]] -= amount
            self.inflow[way[-1]] += amount
            for s in way:
                self.reached.pop(s, None)
        # what is still too much can't be used in any later round either: the last words on the source go, new ones first
        grown = np.bincount(self.pattern, self.words, len(self.sizes)).astype(np.int64) - before
        for s in np.flatnonzero(self.inflow > self.quotas).tolist():
            own = self.edges(s)
            for most in (np.minimum(self.words[own], grown[self.pattern[own]]), self.words[own]):
                most = np.minimum(most, self.words[own])
                over = int(self.inflow[s] - self.quotas[s])
                cut = np.clip(over - (most[::-1].cumsum() - most[::-1]), 0, most[::-1])[::-1]
                self.words[own] -= cut
                grown[self.pattern[own]] -= cut
                self.inflow[s] -= cut.sum()
        return grown


def route(starts: np.ndarray, sources: np.ndarray, sizes: np.ndarray, quotas: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Words taken from each pattern: the largest flow to the quotas, and among those one of least repetition cost.

    Round k of a pattern costs k a word. Among flows of equal cost the order of the patterns and sources decides. Pattern p
    has the sources numbered sources[starts[p] : starts[p + 1]].
    """
    flow = Flow(starts, sources, sizes, quotas)
    for _ in range(rounds):
        flow.add_round()
    return np.bincount(flow.pattern, flow.words, len(sizes)).astype(np.int64)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, sources: Column, *, budget: float = 1.5, weights: tuple[float, ...] = WEIGHTS, most: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``sources`` (sorted), size, source_size and target (of its first source), taken.

    ``sources`` is an array column, null elements allowed: a null source is a source of its own. An empty array belongs to
    none and is never taken, nor is a null one. ``taken`` counts words with repeats, at most ``most`` times the size; the document at which a
    pattern's share ends may be taken in part, so sources come within a word of their targets, where the flow can reach them. Null and empty texts have
    size 0; very long ones are counted whole. Repeated rows count each; rows with equal places in the order go by id. Other columns are ignored. An empty table gives an empty one.
    The driver holds a row a pattern, some hundred bytes each, whatever the number of documents.
    """
    rows = _sized(docs, sources, seed, id_col, text_col)
    spark = rows.sparkSession
    plan = _plan(rows, budget, weights, most)
    rests = spark.createDataFrame(plan.select(["p", "rest"]))
    # where each pattern's last round ends: first the part of the order, then the document
    parts = rows.groupBy("pattern", "part").agg(F.sum("size").alias("part_size"))
    up_to = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part_size").over(up_to), F.lit(0)))
    ends = parts.join(rests, parts["pattern"].eqNullSafe(rests["p"])).where("before < rest AND rest <= before + part_size").select("pattern", "part", "before").collect()
    # the plan goes back with them, as a table of known size: while it's small Spark broadcasts it, so no pattern's documents are moved
    end_of = {r["pattern"]: (r["part"], r["before"]) for r in ends}
    own = [end_of.get(p, (-1, None)) for p in plan["p"].to_pylist()]
    planned = spark.createDataFrame(plan.append_column("end_part", pa.array([e for e, _ in own], pa.int32())).append_column("before", pa.array([b for _, b in own], pa.int64())))
    known = rows.join(planned, rows["pattern"].eqNullSafe(planned["p"]))
    columns = ["id", "sources", "size", "source_size", "target"]
    plain = known.where("part <> end_part").select(*columns, (F.col("size") * (F.col("whole") + (F.col("part") < F.col("end_part")).cast("long"))).alias("taken"))
    last = _taken_in_order(known.where("part = end_part")).select(*columns, (F.col("size") * F.col("whole") + F.greatest(F.lit(0), F.least("size", "left"))).alias("taken"))
    return plain.unionAll(last).withColumnRenamed("id", id_col)


def _sized(docs: DataFrame, sources: Column, seed: int, id_col: str, text_col: str) -> DataFrame:
    """Settled rows: row, id, sources, size, pattern, order and its part."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.array_sort(F.array_distinct(sources.cast("array<string>"))).alias("sources"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("order"),
    )
    key = F.to_json("sources").alias("pattern")
    return settle(rows.select("*", key, F.shiftrightunsigned("order", 64 - (PARTS.bit_length() - 1)).cast("int").alias("part")))


def _patterns(rows: DataFrame) -> tuple[pa.Table, list[Source], np.ndarray, np.ndarray, np.ndarray]:
    """All patterns (pattern, sources, size) in order, the sources' names in order, and for route() the patterns' starts, source numbers and sizes."""
    found = rows.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size")).toArrow().combine_chunks()
    # costs tie, and what stands first is routed first: null last
    found = found.take(pc.sort_indices(found, [("pattern", "ascending")], null_placement="at_end"))
    lists = found["sources"].combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.string()))
    members = lists.flatten()
    names = in_order(members.unique().to_pylist())
    number = {s: k for k, s in enumerate(names)}
    coded = members.dictionary_encode()
    code_of = np.array([number[s] for s in coded.dictionary.to_pylist()], np.int64)
    codes = np.full(len(members), len(names) - 1, np.int64)
    valid = np.asarray(members.is_valid())
    codes[valid] = code_of[coded.indices.drop_null().to_numpy()]
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    return found, names, np.concatenate([[0], lengths.cumsum()]), codes, found["size"].to_numpy().astype(np.int64)


def _targets(names: list[Source], starts: np.ndarray, codes: np.ndarray, sizes: np.ndarray, budget: float, weights: tuple[float, ...], most: int) -> tuple[dict[Source, int], dict[Source, float]]:
    """Words in each source, and its target."""
    of_source = np.bincount(codes, np.repeat(sizes, np.diff(starts)), len(names)).astype(np.int64).tolist()
    by_name = dict(zip(names, of_source, strict=True))
    return by_name, share_targets(by_name, budget * int(sizes.sum()), weights, most)


def _plan(rows: DataFrame, budget: float, weights: tuple[float, ...], most: int) -> pa.Table:
    """A row a pattern: p, source_size, target, whole (rounds) and rest (words of one more)."""
    found, names, starts, codes, sizes = _patterns(rows)
    by_name, targets = _targets(names, starts, codes, sizes, budget, weights, most)
    taken = route(starts, codes, sizes, np.array([round(targets[s]) for s in names], np.int64), most)
    whole = np.where(sizes > 0, taken // np.maximum(sizes, 1), 0)
    some = np.diff(starts) > 0
    source_size, target = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
    lead = codes[starts[:-1][some]]
    source_size[some] = np.array([by_name[s] for s in names], np.int64)[lead]
    target[some] = np.array([targets[s] for s in names], float)[lead]
    return pa.table({"p": found["pattern"], "source_size": source_size, "target": target, "whole": whole, "rest": taken - whole * sizes})


def _taken_in_order(last: DataFrame) -> DataFrame:
    """``left`` of the rest for each row of the parts where patterns end. Rows are dealt to ranges of their order, since a repeated id may fill such a part."""
    ranged = in_ranges(last, "p", "order", "id", "row")
    sums = ranged.groupBy("range_no", "p").agg(F.sum("size").alias("range_size"))
    sums = sums.select(F.col("range_no").alias("of_range"), F.col("p").alias("of_p"), F.coalesce(F.sum("range_size").over(earlier(["p"])), F.lit(0)).alias("in_earlier"))
    own = Window.partitionBy("range_no", "p").orderBy("order", "id", "row").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("in_range", F.coalesce(F.sum("size").over(own), F.lit(0)))
    met = inside.join(sums, (F.col("range_no") == F.col("of_range")) & F.col("p").eqNullSafe(F.col("of_p")))
    return met.withColumn("left", F.col("rest") - F.col("before") - F.col("in_earlier") - F.col("in_range"))


def totals(docs: DataFrame, sources: Column, *, budget: float = 1.5, weights: tuple[float, ...] = WEIGHTS, most: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per source: source, source_size, target, and of the whole mix the words taken and those of them that repeat others.

    Both are sums over all documents of ``mix``, so every row has the same. Without documents there are no rows.
    """
    rows = _sized(docs, sources, seed, id_col, text_col)
    _, names, starts, codes, sizes = _patterns(rows)
    by_name, targets = _targets(names, starts, codes, sizes, budget, weights, most)
    of_source = docs.sparkSession.createDataFrame([(s, by_name[s], targets[s]) for s in names], "source string, source_size long, target double")
    mixed = mix(docs, sources, budget=budget, weights=weights, most=most, seed=seed, id_col=id_col, text_col=text_col)
    # a pattern's repeats are what it takes above its size: all its documents are used once before any is used again
    by_pattern = mixed.groupBy("sources").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    summed = by_pattern.agg(F.sum("taken").alias("taken"), F.sum(F.greatest(F.col("taken") - F.col("size"), F.lit(0))).alias("repeated"))
    return of_source.crossJoin(summed)


#: For sources named by ``source`` and by 'lang:' and the language. The largest flow is the least cut: over all sets of sources,
#: the quotas within plus the words of all patterns not wholly within; with every word once, and twice.
TOTALS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, source AS a, 'lang:' || lang AS b FROM documents),
member AS (SELECT n, size, a AS source FROM d UNION SELECT n, size, b FROM d),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM member GROUP BY source),
weighed AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM sources),
levels AS (SELECT a.k, 2 * a.source_size / a.w AS full_at, ((SELECT 1.5 * sum(size) FROM d) - coalesce(sum(2 * b.source_size) FILTER (2 * b.source_size / b.w < 2 * a.source_size / a.w), 0)) / sum(b.w) FILTER (2 * b.source_size / b.w >= 2 * a.source_size / a.w) AS level
           FROM weighed a, weighed b GROUP BY a.k, a.source_size, a.w),
targets AS (SELECT source, source_size, k, least(2.0 * source_size, w * coalesce((SELECT min_by(level, full_at) FROM levels WHERE level <= full_at), 1e300)) AS target FROM weighed),
patterns AS (SELECT mask, sum(size) AS size FROM (SELECT n, any_value(size) AS size, bit_or(1::BIGINT << CAST(k AS INTEGER)) AS mask FROM member JOIN sources ON member.source IS NOT DISTINCT FROM sources.source GROUP BY n) GROUP BY mask),
sets AS (SELECT t FROM range(0, CAST(2 ** (SELECT count(*) FROM sources) AS BIGINT)) r(t)),
inside AS (SELECT t, coalesce(sum(round_even(target, 0)) FILTER ((t >> CAST(k AS INTEGER)) & 1 = 1), 0) AS quota FROM sets, targets GROUP BY t),
outside AS (SELECT t, coalesce(sum(size) FILTER (mask & ~t <> 0), 0) AS words FROM sets, patterns GROUP BY t),
flows AS (SELECT CAST(min(quota + words) AS BIGINT) AS once, CAST(min(quota + 2 * words) AS BIGINT) AS twice FROM inside JOIN outside USING (t))
SELECT source, source_size, round(target, 3) AS target, twice AS taken, twice - once AS repeated FROM targets, flows
"""
