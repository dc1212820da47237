"""How filters interact: what each removes in every order, and its Shapley share.

A document's failures make a mask, one bit a filter. Spark counts documents by part and mask: with five filters at most 32
cells a part, whatever the number of documents. From those cells all orders follow: permutations are visited by swaps of
two neighbours (Steinhaus, Johnson and Trotter), and a swap changes no step but the two it swaps, so only those two are
read from the cells again. What a filter removes is added up along the walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed by the query's contract.
SPACE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
COPY = "E"
MEASURES = ("n", "good", "toxic")
#: Parts that the walk holds at a time.
PARTS_AT_A_TIME = 1024

RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def swaps(n: int) -> Iterator[int]:
    """Places ``i`` such that swapping what stands at ``i`` and ``i + 1``, one after another, visits all permutations of ``n`` once."""
    if n < 2:
        return
    below = swaps(n - 1)
    down = True
    while True:
        # the last element goes through all places of one order of the others, then those make one swap of their own
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        inner = next(below, None)
        if inner is None:
            return
        yield inner + 1 if down else inner
        down = not down


def walk(cells: np.ndarray, filters: str) -> Iterator[tuple[str, np.ndarray]]:
    """``filters`` in each order, with [part, step, measure] of what each step removes. ``cells``: [part, mask, measure].

    The array is changed in place from one order to the next.
    """
    masks = np.arange(1 << len(filters))
    order = list(range(len(filters)))
    removed = np.zeros((cells.shape[0], len(filters), cells.shape[2]), cells.dtype)

    def read(step: int) -> None:
        earlier = sum(1 << f for f in order[:step])
        here = ((masks & earlier) == 0) & ((masks >> order[step]) & 1 == 1)
        removed[:, step] = cells[:, here].sum(axis=1)

    for step in range(len(filters)):
        read(step)
    yield "".join(filters[f] for f in order), removed
    for i in swaps(len(filters)):
        order[i], order[i + 1] = order[i + 1], order[i]
        read(i)
        read(i + 1)
        yield "".join(filters[f] for f in order), removed


def audit_cells(parts: list[str], cells: np.ndarray, filters: str = FILTERS) -> pa.RecordBatch:
    """The rows of ``RESULT`` for some parts. ``cells``: [part, mask, measure], the measures as in ``MEASURES``."""
    size, place = len(filters), {f: k for k, f in enumerate(filters)}
    masks = np.arange(1 << size)
    total = cells[:, :, 0].sum(axis=1)
    fails = np.stack([cells[:, (masks >> k) & 1 == 1, 0].sum(axis=1) for k in range(size)], axis=1)
    alone = np.stack([cells[:, 1 << k, 0] for k in range(size)], axis=1)
    shapley = np.zeros_like(fails)
    orders, steps = [], []
    for order, removed in walk(cells, filters):
        which = [place[f] for f in order]
        shapley[:, which] += removed[:, :, 0]
        left = total[:, None] - removed[:, :, 0].cumsum(axis=1)
        orders.append((order, which))
        steps.append(np.stack([left, removed[:, :, 0], fails[:, which] - removed[:, :, 0], alone[:, which], removed[:, :, 1], removed[:, :, 2]]))
    found = np.stack(steps)  # order, column, part, step
    shares = np.stack([shapley[:, which] for _, which in orders])
    columns = [np.moveaxis(found, 1, 0)[k].transpose(1, 0, 2).ravel() for k in range(6)] + [shares.transpose(1, 0, 2).ravel()]
    names = [order for order, _ in orders for _ in range(size)]
    labels = [np.repeat(np.array(parts, object), len(names)), names * len(parts), np.tile(np.arange(1, size + 1, dtype=np.int32), len(orders) * len(parts))]
    arrays = [pa.array(labels[0], pa.string()), pa.array(labels[1], pa.string()), pa.array(labels[2], pa.int32()), *(pa.array(c, pa.int64()) for c in columns)]
    return pa.RecordBatch.from_arrays(arrays, ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


def text_failures(text: Column) -> Column:
    """The contract's filters A to D, as the low bits of a mask. ``text`` isn't null."""
    words = F.array_remove(F.split(text, SPACE), "")
    few = F.lit(100)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    flags = [F.size(words) < 100, few * F.size(F.array_distinct(words)) < 80 * F.size(words), few * capitals > 10 * F.char_length(text), text.rlike(r"[#$%&*|]")]
    bits = [F.when(flag, 1 << k).otherwise(0) for k, flag in enumerate(flags)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def mask_cells(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part``, ``mask``, n, good, toxic: the documents of each part that fail exactly the filters of ``mask``.

    Filter E: a smaller id has the same text. Texts meet as SHA-256 digests. Copies are counted by digest, part and labels
    before they meet, so a text that fills a third of the table is a few rows there; a copy's own text fails or passes A to
    D like the others', so it's looked at where it stands.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_failures(text).alias("mask"))
    rows = rows.groupBy("doc", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    # a row without any mark counts like one without labels
    marks = marks.where("good OR toxic")
    flag = lambda c: F.coalesce(c, F.lit(False))
    marked = rows.join(marks, F.col("doc") == F.col("labelled"), "left").withColumns({"good": flag(F.col("good")), "toxic": flag(F.col("toxic"))})
    # an id is one row of its digest, part and labels here, so the least id's n counts all its rows
    known = F.col("doc").isNotNull()
    cells = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.min("doc").alias("least"), F.min_by("n", F.when(known, F.col("doc"))).alias("n_least"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_unnamed")
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    originals = F.when(first, F.col("n_least")).otherwise(0)
    cells = cells.select("part", "mask", "good", "toxic", (originals + F.col("n_unnamed")).alias("firsts"), F.col("n") - originals).toDF("part", "mask", "good", "toxic", "firsts", "copies")
    both = F.inline(F.array(F.struct(F.col("mask").alias("fails"), F.col("firsts").alias("rows")), F.struct((F.col("mask") + (1 << FILTERS.index(COPY))).alias("fails"), F.col("copies").alias("rows"))))
    spread = cells.select("part", "good", "toxic", both)
    return spread.groupBy("part", F.col("fails").alias("mask")).agg(F.sum("rows").alias("n"), F.sum(F.when(F.col("good"), F.col("rows")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("rows")).otherwise(0)).alias("toxic"))


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The rows of ``RESULT`` from ``part``, ``mask``, n, good and toxic: every part, order and step. No cells give no rows.

    A part is one row here, of at most 2 ** len(filters) cells; parts are dealt over tasks, so there may be many.
    """
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, PARTS_AT_A_TIME):
                piece = batch.slice(at, PARTS_AT_A_TIME)
                lists = piece.column(1)
                flat, owner = lists.flatten(), np.repeat(np.arange(piece.num_rows), lists.value_lengths().to_numpy())
                table = np.zeros((piece.num_rows, 1 << len(filters), len(MEASURES)), np.int64)
                mask = flat.field("mask").to_numpy()
                for k, name in enumerate(MEASURES):
                    np.add.at(table, (owner, mask, k), flat.field(name).to_numpy())
                yield audit_cells(piece.column(0).to_pylist(), table, filters)

    return by_part.mapInArrow(work, RESULT)


def audit_filters(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order of the five filters and step: what is kept after it, removed by it, and so on.

    Null texts are empty and equal empty ones; very long texts are read whole. A null part is the empty string. Rows that
    repeat an id with the same text are no copies of each other, since none has the smaller id; each counts. A row with a
    null id has no smaller one and isn't smaller than any: it never fails E. A document is good or toxic if any of its label
    rows says so; one without labels is neither. Other columns are ignored. An empty table gives an empty one.
    """
    return audit(mask_cells(docs, labels, **columns))


AUDIT_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
least AS (SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
masked AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN words.doc_id > first_id THEN 16 ELSE 0 END AS mask
  FROM words JOIN least USING (text) LEFT JOIN marks ON marks.doc_id = words.doc_id),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masked GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, bit)),
orders AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, list_sum(bits[1:step]) - bits[step] AS earlier FROM orders, range(1, 6) r(step)),
found AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, (SELECT filter_order, step, bit, CAST(earlier AS INTEGER) AS earlier FROM steps) GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM found
"""
