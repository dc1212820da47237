"""SimHash near-duplicates, linked with BK-trees.

A document's fingerprint has a bit set where more than half of its shingles' hashes have it. Fingerprints that differ in at
most two bits are linked. Sharding: of four 16-bit blocks, two bits can spoil two at most, so linked fingerprints agree in
at least one of the six pairs of blocks; each fingerprint goes to the six shards named by those pairs. In each shard a
BK-tree (children keyed by integer Hamming distance to their parent) is built, and every fingerprint follows only the edges
within the radius. A shard with very many fingerprints is sharded again by the 32 bits in which they may still differ, and
once more by the last 16: then at most 256 are left in a shard, so copies of a row stay below 6 * 6 * 6 however large a shard
is. Links are reduced to a spanning forest before they are joined into components.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasift.llm.common import settle, tidy
from metasift.llm.graph import connected_components

#: Fixed by the query's contract.
SEED = 42
RADIUS = 2
BLOCKS = 4
BLOCK_PAIRS = tuple(itertools.combinations(range(BLOCKS), BLOCKS - RADIUS))
#: Bits of a block, by level of sharding.
BLOCK_BITS = (16, 8, 4)
#: Fingerprints of a shard that one tree holds; at the last level a shard has no more than two blocks' values, 256.
TREE_SIZE = 2048
WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingles(text: str, width: int) -> list[bytes]:
    """Runs of ``width`` words with repeats; all words where there are fewer. Only A-Z is lower-cased and only ASCII space splits."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))


def fingerprint(text: str, width: int = 3) -> int:
    pieces = shingles(text, width)
    if not pieces:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in pieces), np.uint64, len(pieces))
    set_bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(WEIGHTS[2 * set_bits > len(pieces)].sum())


def fingerprints(docs: DataFrame, *, width: int = 3, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """``doc`` (the id), ``key`` (the row's own long, null without ``key_col``) and ``fp`` (the fingerprint's bits as a signed long) of every row."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            fps = np.array([fingerprint(t.as_py() or "", width) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc", "key", "fp"])
            tidy()

    key = F.col(key_col) if key_col else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), key.cast("long").alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches, "doc long, key long, fp long")


def hamming(a: int, b: int) -> int:
    return (a ^ b).bit_count()


class BKTree:
    """Items by Hamming distance: each child hangs on the edge of its distance to the parent."""

    def __init__(self) -> None:
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, item: int) -> None:
        if not self.items:
            self.items.append(item)
            self.children.append({})
            return
        at = 0
        while True:
            edge = hamming(item, self.items[at])
            below = self.children[at].get(edge)
            if below is None:
                self.children[at][edge] = len(self.items)
                self.items.append(item)
                self.children.append({})
                return
            at = below

    def within(self, item: int, radius: int) -> Iterator[int]:
        """Numbers of the items at most ``radius`` away."""
        waiting = [0] if self.items else []
        while waiting:
            at = waiting.pop()
            edge = hamming(item, self.items[at])
            if edge <= radius:
                yield at
            children = self.children[at]
            if len(children) > 2 * radius + 1:
                waiting += [children[e] for e in range(edge - radius, edge + radius + 1) if e in children]
            else:
                waiting += [child for e, child in children.items() if abs(e - edge) <= radius]


class Forest:
    """Union-find that keeps the links that joined two trees."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def links_within(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``fps``: each is looked up in the tree of those before it."""
    tree, forest, out = BKTree(), Forest(len(fps)), []
    for i, fp in enumerate(fps):
        out += [(i, j) for j in tree.within(fp, radius) if forest.join(i, j)]
        tree.add(fp)
    return out


def sharded(rows: DataFrame, bits: int) -> DataFrame:
    """Each of ``rows`` (shard, rest: its bits outside of what the shard agrees in, fp) once for each pair of the four blocks of ``rest``.

    Shards are named by a hash. Two that share a name make one tree with links inside of each alone, as every link is checked.
    """
    block = lambda k: F.shiftrightunsigned("rest", k * bits).bitwiseAND(F.lit((1 << bits) - 1))
    found = []
    for n, (a, b) in enumerate(BLOCK_PAIRS):
        c, d = (k for k in range(BLOCKS) if k not in (a, b))
        found.append(F.struct(F.xxhash64("shard", F.lit(n), block(a), block(b)).alias("shard"), F.shiftleft(block(c), bits).bitwiseOR(block(d)).alias("rest")))
    return rows.select("fp", F.explode(F.array(*found)).alias("s")).select("s.shard", "s.rest", "fp")


def fingerprint_links(distinct: DataFrame, tree_size: int = TREE_SIZE) -> DataFrame:
    """``a``, ``b``: links that connect what all links among the different ``fp`` of ``distinct`` connect."""
    rows, links = distinct.select(F.lit(0).cast("long").alias("shard"), F.col("fp").alias("rest"), "fp"), None
    for bits in BLOCK_BITS:
        found = sharded(rows, bits)
        sizes = found.groupBy(F.col("shard").alias("name")).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        shared = settle(found.join(sizes, F.col("shard") == F.col("name")).select("shard", "rest", "fp", "size"))
        small = F.lit(True) if bits == BLOCK_BITS[-1] else F.col("size") <= tree_size
        own = shared.where(small).select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(_trees, "a long, b long")
        links = own if links is None else links.unionAll(own)
        rows = shared.where(~small)
        if bits == BLOCK_BITS[-1] or rows.isEmpty():
            return links
    return links


def _trees(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, to links; one shard's fingerprints are held at a time."""
    held: list[np.ndarray] = []
    key: int | None = None
    out: list[tuple[int, int]] = []

    def solve() -> None:
        fps = np.concatenate(held)
        signed, plain = fps.tolist(), fps.view(np.uint64).tolist()
        out.extend((signed[i], signed[j]) for i, j in links_within(plain, RADIUS))

    def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        table = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], ["a", "b"])

    for batch in stream:
        if not batch.num_rows:
            continue
        shard, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for start, stop in itertools.pairwise([0, *(np.flatnonzero(np.diff(shard) != 0) + 1).tolist(), batch.num_rows]):
            if held and int(shard[start]) != key:
                solve()
                held = []
            key = int(shard[start])
            held.append(fp[start:stop])
        if len(out) > 10_000:
            yield batch_of(out)
            out.clear()
    if held:
        solve()
    yield batch_of(out)


def fingerprint_groups(marked: DataFrame, tree_size: int = TREE_SIZE) -> DataFrame:
    """Each ``fp`` of ``marked`` and its ``group``, one fingerprint of those it is linked to over any chain. Ids play no part, so a repeated one links nothing."""
    distinct = settle(marked.select("fp").distinct())
    components = connected_components(fingerprint_links(distinct, tree_size))
    return distinct.join(components, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("group"))


def near_duplicates(docs: DataFrame, *, width: int = 3, tree_size: int = TREE_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id it is linked to over any chain.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows and equal texts share
    a component; rows of one id with different texts don't, unless their fingerprints are linked. Rows with a null id link
    like others and take their component from them (null if they have none). Other columns are ignored. An empty table
    gives an empty one.
    """
    marked = settle(fingerprints(docs, width=width, id_col=id_col, text_col=text_col))
    least = marked.groupBy("fp").agg(F.min("doc").alias("least"))
    grouped = settle(fingerprint_groups(marked, tree_size).join(least, "fp"))
    of_group = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    joined = marked.join(grouped.join(of_group, "group").select("fp", "component_id"), "fp", "left")
    return joined.select(F.col("doc").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame, key_col: str, *, width: int = 3, tree_size: int = TREE_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key``: that of one row for each group of near-duplicates, the one with the smallest id, then the smallest key; null ids come last."""
    marked = settle(fingerprints(docs, width=width, id_col=id_col, text_col=text_col, key_col=key_col))
    first = F.min(F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "key"))
    best = marked.groupBy("fp").agg(first.alias("best")).join(fingerprint_groups(marked, tree_size), "fp")
    return best.groupBy("group").agg(F.min("best").alias("best")).select("best.key")
