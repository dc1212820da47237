"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are reduced to lower-case letters and digits with single spaces. An item is cut into overlapping
units: long ones of 120 characters at every 60th, and short ones of 60 characters at every word. So an excerpt that keeps
60 characters from the beginning of some word on is found, wherever it stands: any excerpt of 60 characters and one word
more. A unit of ``m`` characters that occurs in a text with at most ``e``
edits shares at least ``m - q + 1 - q * e`` q-grams with it, all of them inside a strip of e + 1 diagonals (place in the text
less place in the unit). Shared q-grams are counted in diagonal bands twice as wide, each overlapping half of the next, so
some band holds the whole strip. An item's q-grams are listed once: those of one band are sorted by their place in the item,
and units that hold too few of them are dropped. The region of each unit that is left is verified by banded alignment.
Short units that stand in a text without an edit are found first, by their first q-gram; q-grams deep inside of what they
cover are left out of the count, so a text that repeats a passage over and over costs no more than another. Every place is
reported: places that overlap make one span, others are spans of their own.
"""

from __future__ import annotations

import bisect
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metasift.llm.common import fresh_path, tidy

Q = 10
EDIT_RATE = 0.08
UNIT, UNIT_STEP = 120, 60
SHORT = 60
#: Benchmark characters in one block; each block is broadcast and meets all texts once.
BLOCK_CHARS = 4_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # 2^64 over the golden ratio
FILTER_BITS = 22
#: Characters hashed at a time.
HASHED = 1 << 16
#: Characters of texts searched at a time.
BATCH_CHARS = 1 << 19
BATCH_ROWS = 512
#: Pairs of a place in the texts and a unit that are compared at a time, and pairs of a place and a place in an item that are counted at a time.
PAIRS = 1 << 14
WINDOW_ENTRIES = 1 << 19
MATCHES = "array<struct<item_id:long,start:int,end:int,edits:int,chars:int>>"


@lru_cache(maxsize=1)
def _reduced() -> np.ndarray:
    """Each character's lower-case form if it is a letter, mark or digit, else 0; a form of several characters stays as it is."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LMN":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def reduce_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Reduced characters (0 between words and at both ends) and the place of each in ``text``."""
    codes = _reduced()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    padded = np.concatenate((np.zeros(1, np.uint32), codes))
    kept = np.flatnonzero((padded[1:] != 0) | (padded[:-1] != 0))
    tail = [] if len(kept) and codes[kept[-1]] == 0 else [len(codes)]
    return np.concatenate((np.zeros(1, np.uint32), codes[kept], np.zeros(len(tail), np.uint32))), np.concatenate(([0], kept, tail)).astype(np.int64)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
    rising, falling = (np.full(HASHED, base, np.uint64) for base in (MULTIPLIER, inverse))
    rising[0] = falling[0] = 1
    return np.cumprod(rising), np.cumprod(falling)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q-gram: a polynomial of its characters, as a difference of prefix sums shifted back to its start."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    rising, falling = _powers()
    out, step = np.empty(n, np.uint64), HASHED - q
    for at in range(0, n, step):
        piece = codes[at : at + step + q - 1].astype(np.uint64)
        piece += np.uint64(1)
        piece *= rising[: len(piece)]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(piece)))
        own = sums[q:] - sums[:-q]
        own *= falling[: len(own)]
        own *= MULTIPLIER
        out[at : at + len(own)] = own ^ (own >> np.uint64(29))
    return out


def budget(chars: int, rate: float, q: int) -> int:
    """Edits allowed: the rate, but never so many that the lemma leaves no shared q-gram."""
    return max(0, min(int(chars * rate), (chars - q) // q))


@dataclass
class Index:
    """Units of a block of items, and the items' q-grams. Units of one length class and item stand together.

    ``text`` holds all items one after another; a unit is ``size`` characters of it from ``begin`` on, ``at`` its place in the
    item. ``classes`` holds each length class: unit length, edits and least shared q-grams by item, and where the item's units
    begin (one entry more than items). ``hashes`` are the q-grams; q-gram k is held by the entries ``first[k]`` to
    ``first[k + 1]`` of ``owner`` (an item's number here), each with its places ``place_first[e]`` to ``place_first[e + 1]``.
    ``lead`` are the first q-grams of each item's shortest units, equal ones once, and ``lead_unit`` those units.
    """

    item: np.ndarray
    text: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    edits: np.ndarray
    at: np.ndarray
    of_item: np.ndarray
    classes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    longest: int
    hashes: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    place_first: np.ndarray
    place: np.ndarray
    present: np.ndarray
    lead: np.ndarray
    lead_unit: np.ndarray

    def unit(self, number: int) -> np.ndarray:
        return self.text[self.begin[number] : self.begin[number] + self.size[number]]


def unit_starts(whole: np.ndarray, size: int) -> list[int]:
    """Long units begin at every 60th character, short ones at every word; the last one ends with the item."""
    last = len(whole) - size
    if last <= 0:
        return [0]
    words = np.flatnonzero(whole[:last] == 0).tolist() if size == SHORT else list(range(0, last, UNIT_STEP))
    return [*words, last]


def build_index(items: list[tuple[int, str]], q: int = Q, rate: float = EDIT_RATE) -> Index:
    numbers, wholes = [], []
    for number, text in items:
        whole = reduce_text(text)[0]
        if len(whole) >= q:  # else fewer than q - 2 characters: no q-gram, see find_leaks
            numbers.append(number)
            wholes.append(whole)
    offsets = np.concatenate(([0], np.cumsum([len(w) for w in wholes]))).astype(np.int64)
    of_item, at, size, edits, classes, leads = [], [], [], [], [], []
    for kind in (UNIT, SHORT):
        lengths = np.array([min(kind, len(w)) for w in wholes], np.int64)
        allowed = np.array([budget(n, rate, q) for n in lengths.tolist()], np.int64)
        begins = [len(at)]
        for k, whole in enumerate(wholes):
            # an item that is no longer than a short unit is one long unit already
            starts = unit_starts(whole, kind) if kind == UNIT or len(whole) > SHORT else []
            if kind == SHORT or len(whole) <= SHORT:
                seen: set[bytes] = set()
                for unit, start in enumerate(starts, len(at)):
                    held = whole[start : start + kind].tobytes()
                    if held not in seen:
                        seen.add(held)
                        leads.append(unit)
            at += starts
            begins.append(len(at))
            of_item += [k] * len(starts)
            size += [int(lengths[k])] * len(starts)
            edits += [int(allowed[k])] * len(starts)
        classes.append((lengths, allowed, lengths - q + 1 - q * allowed, np.array(begins, np.int64)))
    text = np.concatenate([np.empty(0, np.uint32), *wholes])
    of_item, at, size = np.array(of_item, np.int64), np.array(at, np.int64), np.array(size, np.int64)
    begin, lead_unit = offsets[of_item] + at, np.array(leads, np.int64)
    hashed = grams(text, q)
    lead = hashed[begin[lead_unit]]
    order = np.argsort(lead, kind="stable")
    lead, lead_unit = lead[order], lead_unit[order]

    keep = np.flatnonzero(np.arange(len(hashed)) + q <= np.repeat(offsets[1:], np.diff(offsets))[: len(hashed)])
    owner = np.searchsorted(offsets, keep, "right") - 1
    place, hashed = keep - offsets[owner], hashed[keep]
    order = np.argsort(hashed, kind="stable")  # items and places stay in order
    hashed, owner, place = hashed[order], owner[order], place[order]
    new_hash = np.concatenate((np.ones(min(1, len(hashed)), bool), hashed[1:] != hashed[:-1]))
    new_entry = new_hash.copy()
    new_entry[1:] |= owner[1:] != owner[:-1]
    entries = np.flatnonzero(new_entry)
    present = np.zeros(1 << FILTER_BITS, bool)
    present[hashed >> np.uint64(64 - FILTER_BITS)] = True
    return Index(
        item=np.array(numbers, np.int64)[of_item] if numbers else np.empty(0, np.int64),
        text=text,
        begin=begin,
        size=size,
        edits=np.array(edits, np.int64),
        at=at,
        of_item=of_item,
        classes=classes,
        longest=max(map(len, wholes), default=0),
        hashes=hashed[new_hash],
        first=np.append(np.flatnonzero(new_hash[entries]), len(entries)),
        owner=owner[entries].astype(np.int32),
        place_first=np.append(entries, len(hashed)),
        place=place.astype(np.int32),
        present=present,
        lead=lead,
        lead_unit=lead_unit,
    )


def align(unit: np.ndarray, region: np.ndarray, limit: int) -> tuple[int, int, int] | None:
    """Fewest edits between ``unit`` and any part of ``region``, with that part's start and end, if at most ``limit``.

    Row by row of the unit; a cell carries its edits and its start in one number, so the smallest edits win and then the
    latest start. Only cells that can end within the limit matter, and the region is a band already.
    """
    n, big = len(region), np.int64(1) << 32
    at = np.arange(n + 1, dtype=np.int64)
    row = big - 1 - at  # no edits yet; a start further right makes a smaller number
    for code in unit:
        change = row[:-1] + np.where(region == code, 0, big)
        new = np.concatenate((row[:1] + big, np.minimum(change, row[1:] + big)))
        row = np.minimum.accumulate(new - at * big) + at * big
        if int(row.min() // big) > limit:
            return None
    end = int(row.argmin())
    edits, start = int(row[end] // big), int(big - 1 - row[end] % big)
    return (edits, start, end) if edits <= limit else None


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, one range after another."""
    before = np.cumsum(counts) - counts
    return np.repeat(first - before, counts) + np.arange(counts.sum())


def exact_places(index: Index, codes: np.ndarray, owner: np.ndarray, hashed: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Units and the places where they stand without an edit: of each item, its shortest units."""
    low = np.searchsorted(index.lead, hashed[at], "left")
    counts = np.searchsorted(index.lead, hashed[at], "right") - low
    at, low, counts = at[counts > 0], low[counts > 0], counts[counts > 0]
    ends = np.cumsum(counts)
    start = 0
    while start < len(at):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        unit, place = index.lead_unit[ranges(low[start:stop], counts[start:stop])], np.repeat(at[start:stop], counts[start:stop])
        start = stop
        inside = place + index.size[unit] <= len(codes)
        unit, place = unit[inside], place[inside]
        inside = owner[place] == owner[place + index.size[unit] - 1]
        unit, place = unit[inside], place[inside]
        steps = np.arange(SHORT)[None, :]
        own = index.text[np.minimum(index.begin[unit][:, None] + steps, len(index.text) - 1)]
        same = (codes[np.minimum(place[:, None] + steps, len(codes) - 1)] == own) | (steps >= index.size[unit][:, None])
        held = np.flatnonzero(same.all(axis=1))
        yield unit[held], place[held]


class Spans:
    """Parts of the texts that an item's units cover, apart from each other; with the edits and characters compared."""

    def __init__(self) -> None:
        self.held: list[tuple[int, int, int, int]] = []

    def covers(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.held, (start, 1 << 62)) - 1
        return k >= 0 and end <= self.held[k][1]

    def add(self, start: int, end: int, edits: int, chars: int) -> None:
        """Spans that overlap become one; those that only touch are two finds."""
        k = bisect.bisect_left(self.held, (start,))
        if k and self.held[k - 1][1] > start:
            k -= 1
        last = k
        while last < len(self.held) and self.held[last][0] < end:
            a, b, e, c = self.held[last]
            start, end, edits, chars = min(start, a), max(end, b), edits + e, chars + c
            last += 1
        self.held[k:last] = [(start, end, edits, chars)]


def merged(item: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Item, start, end and characters of the spans that overlapping places of an item make."""
    order = np.lexsort((end, start, item))
    item, start, end = item[order], start[order], end[order]
    wide = item * (end.max() + 1)  # items one after another, so ends of one item never reach into the next
    reach = np.maximum.accumulate(end + wide)
    new = np.flatnonzero(np.concatenate(([True], start[1:] + wide[1:] >= reach[:-1])))
    last = np.append(new[1:], len(item)) - 1
    return item[new], start[new], reach[last] - wide[last], np.add.reduceat(end - start, new)


def candidates(index: Index, place: np.ndarray, entry: np.ndarray, text: np.ndarray, q: int) -> Iterator[tuple[int, int, int, int]]:
    """Text, unit, lowest and highest place where it may begin: where a band of diagonals reaches its bound. Long units first.

    ``place`` and ``entry``: q-grams of the texts, by place, and the index entry of each; ``text``: which text each is in.
    """
    counts = index.place_first[entry + 1] - index.place_first[entry]
    at = np.repeat(place, counts)
    texts, item = np.repeat(text, counts), np.repeat(index.owner[entry].astype(np.int64), counts)
    places = index.place[ranges(index.place_first[entry], counts)].astype(np.int64)
    diagonal, span = at - places + index.longest, index.longest + 1  # diagonals are positive
    for lengths, edits, needed, begins in index.classes:
        band = diagonal // (edits[item] + 1)
        # a band lies in one text, but for its overhang; the text is part of the key
        keys = np.concatenate((band, band - 1)) * len(lengths) + np.concatenate((item, item))
        both, own_places = np.concatenate((texts, texts)), np.concatenate((places, places))
        order = np.lexsort((own_places, keys, both))
        keys, both, own_places = keys[order], both[order], own_places[order]
        group = np.cumsum(np.concatenate(([False], (keys[1:] != keys[:-1]) | (both[1:] != both[:-1]))))
        line = group * span + own_places
        own = keys % len(lengths)
        ahead = np.arange(len(line)) + needed[own] - 1
        near = ahead < len(line)
        # enough of one band's q-grams within a unit's length, wherever it begins
        near[near] = line[ahead[near]] - line[near] <= lengths[own[near]] - q
        near[near] = group[ahead[near]] == group[near]
        for g in np.unique(group[near]).tolist():
            row = int(np.searchsorted(group, g))
            k = int(own[row])
            units = np.arange(begins[k], begins[k + 1])
            starts = g * span + index.at[units]
            held = np.searchsorted(line, np.minimum(starts + lengths[k] - q, (g + 1) * span - 1), "right") - np.searchsorted(line, starts)
            low = int(keys[row] // len(lengths) * (edits[k] + 1)) - index.longest
            for unit in units[held >= needed[k]].tolist():
                begin = low + int(index.at[unit])
                yield int(both[row]), unit, begin, begin + 2 * int(edits[k] + 1) - 1


def exact(unit: np.ndarray, region: np.ndarray) -> int:
    """Where ``unit`` stands in ``region`` for the last time, or -1."""
    held, wanted = region.tobytes(), unit.tobytes()
    at = held.rfind(wanted)
    while at > 0 and at % 4:
        at = held.rfind(wanted, 0, at + len(wanted) - 1)
    return at // 4 if at >= 0 else -1


def windows(place: np.ndarray, counts: np.ndarray, reach: int) -> Iterator[slice]:
    """Parts of the sorted ``place`` with a bounded sum of ``counts``; each overlaps the next by ``reach`` characters, so no unit is cut."""
    total, start = np.cumsum(counts), 0
    while start < len(place):
        stop = int(np.searchsorted(total, total[start] + WINDOW_ENTRIES, "right"))
        stop = max(stop, int(np.searchsorted(place, place[start] + 2 * reach, "right")))
        yield slice(start, stop)
        if stop >= len(place):
            return
        start = int(np.searchsorted(place, place[stop] - reach))


def search_codes(index: Index, codes: np.ndarray, begins: np.ndarray, q: int) -> dict[tuple[int, int], Spans]:
    """Spans (places in ``codes``) by text and item number. ``begins``: where each text begins in ``codes`` (one entry more than texts)."""
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    hashed = grams(codes, q)
    at = np.flatnonzero(index.present[hashed >> np.uint64(64 - FILTER_BITS)])
    found = np.searchsorted(index.hashes, hashed[at])
    same = (found < len(index.hashes)) & (index.hashes[np.minimum(found, len(index.hashes) - 1)] == hashed[at])
    at, found = at[same], found[same]
    inside = owner[at] == owner[at + q - 1]
    at, found = at[inside], found[inside]
    spans: dict[tuple[int, int], Spans] = defaultdict(Spans)
    if not len(at):
        return spans

    for unit, start in (p for p in exact_places(index, codes, owner, hashed, at) if len(p[0])):
        # what they cover is found already; only q-grams near its borders can be part of anything more
        end = start + index.size[unit]
        start, end = start + (codes[start] == 0), end - (codes[end - 1] == 0)
        for k, a, b, chars in zip(*(x.tolist() for x in merged(index.of_item[unit], start, end)), strict=True):
            spans[int(owner[a]), k].add(a, b, 0, chars)
    reach = UNIT + 2 * max(int(edits.max()) for _, edits, _, _ in index.classes) + 2
    deep = sorted((k, a + reach, b - reach) for (_, k), own in spans.items() for a, b, _, _ in own.held if b - a > 2 * reach)
    hidden_item, hidden_start, hidden_end = np.array(deep, np.int64).reshape(-1, 3).T
    wide = len(codes) + 1
    for part in windows(at, index.place_first[index.first[found + 1]] - index.place_first[index.first[found]], reach):
        counts = index.first[found[part] + 1] - index.first[found[part]]
        entry, place = ranges(index.first[found[part]], counts), np.repeat(at[part], counts)
        if deep:
            key = index.owner[entry].astype(np.int64) * wide
            near = np.searchsorted(hidden_item * wide + hidden_start, key + place, "right") - 1
            hidden = (near >= 0) & (hidden_item[near] * wide == key) & (place + q <= hidden_end[near])
            entry, place = entry[~hidden], place[~hidden]
        for number, unit, low, high in candidates(index, place, entry, owner[place], q) if len(place) else ():
            own, edits, name = index.unit(unit), int(index.edits[unit]), (number, int(index.of_item[unit]))
            left, right = max(int(begins[number]), low - edits), min(int(begins[number + 1]), high + len(own) + edits)
            held = spans.get(name)
            if held and held.covers(max(int(begins[number]), low), min(int(begins[number + 1]), high + len(own))):
                continue
            again = exact(own, codes[left:right])
            match = (0, again, again + len(own)) if again >= 0 else align(own, codes[left:right], edits)
            if match is None:
                continue
            start, end = left + match[1], left + match[2]
            # without the space on either side
            start, end = start + int(codes[start] == 0), end - int(codes[end - 1] == 0)
            if held is None or not held.covers(start, end):
                spans[name].add(start, end, match[0], len(own))
    return spans


def search(index: Index, texts: list[str | None], q: int = Q) -> list[list[dict]]:
    """Matches of each text: every span that an item's units cover, with their edits and characters."""
    out: list[list[dict]] = [[] for _ in texts]
    if not len(index.hashes):
        return out
    numbers = {int(k): int(i) for k, i in zip(index.of_item, index.item, strict=True)}
    at = 0
    while at < len(texts):
        reduced, start, size = [], at, 0
        while at < len(texts) and (at == start or size + len(texts[at] or "") <= BATCH_CHARS):
            reduced.append(reduce_text(texts[at] or ""))
            size += len(reduced[-1][0])
            at += 1
        codes = np.concatenate([r[0] for r in reduced])
        begins = np.concatenate(([0], np.cumsum([len(r[0]) for r in reduced])))
        for (text, item), own in search_codes(index, codes, begins, q).items():
            place = reduced[text][1]
            for a, b, edits, chars in own.held:
                first, last = a - int(begins[text]), b - 1 - int(begins[text])
                out[start + text].append({"item_id": numbers[item], "start": int(place[first]), "end": int(place[last]) + 1, "edits": edits, "chars": chars})
    for leaks in out:
        leaks.sort(key=lambda leak: (leak["item_id"], leak["start"]))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS, item_col: str = "item_id", item_text_col: str = "text", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and ``leaks``: for each place of an item, its id, the span in the text (code points), edits and characters compared.

    Items are taken in blocks of about ``block_chars`` characters. With more than one, each block is a job of its own over all
    rows: its finds are written to the shared folder and its broadcast is destroyed before the next, so no task or driver
    holds more than one. Null texts, items with a null id and null, blank or very short items (fewer than q - 2 characters)
    match nothing. Very long texts are searched whole, in windows with a bounded number of shared q-grams. A column of
    ``docs`` named leaks, in any case, is kept as leaks_before.
    Repeated rows are searched each; items with equal texts are all reported, a repeated row of one item once; an empty
    table on either side gives no leak.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("item_text")).where("item IS NOT NULL AND item_text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    docs = docs.toDF(*without_clash(docs.columns, "leaks"))
    if blocks == 1:
        return _searched(docs, text_col, _sent(spark, items, q, rate), q)

    def kept(df: DataFrame, kind: str) -> str:
        path = fresh_path(spark, kind)
        df.write.parquet(path)
        return path

    items = spark.read.parquet(kept(items, "items"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    keyed = spark.read.parquet(kept(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows"))
    texts = keyed.select("row", F.col(names[docs.columns.index(text_col)]).alias("text"))
    paths = []
    for block in range(blocks):
        sent = _sent(spark, items.where(F.pmod(F.xxhash64("item", "item_text"), F.lit(blocks)) == block), q, rate)
        found = _searched(texts, "text", sent, q).where(F.size("leaks") > 0).select("row", F.lit(block).alias("block"), "leaks")
        paths.append(kept(found, "leaks"))
        sent.destroy()
    # a row's finds are as few as the items that it quotes
    every = spark.read.schema(f"row long, block int, leaks {MATCHES}").parquet(*paths).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("block", "leaks"))).alias("finds"))
    joined = keyed.join(every, "row", "left").select(*names, F.coalesce(F.flatten("finds.leaks"), F.array().cast(MATCHES)).alias("leaks"))
    return joined.toDF(*docs.columns, "leaks")


def without_clash(columns: list[str], name: str) -> list[str]:
    """Column names where none equals ``name``, for Spark regardless of case."""
    taken, out = {c.lower() for c in columns} | {name}, []
    for column in columns:
        while column.lower() == name or column in out:
            column = next(c for c in (f"{column}_before{'' if k == 0 else k}" for k in range(len(columns) + 2)) if c.lower() not in taken)
            taken.add(column.lower())
        out.append(column)
    return out


def _sent(spark: SparkSession, items: DataFrame, q: int, rate: float) -> Broadcast:
    return spark.sparkContext.broadcast(build_index([(r["item"], r["item_text"]) for r in items.collect()], q, rate))


def _searched(docs: DataFrame, text_col: str, sent: Broadcast, q: int) -> DataFrame:
    """``docs`` with ``leaks`` by the items of one block."""
    found_type = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()), ("chars", pa.int32())]))
    result = docs.withColumn("leaks", F.array().cast(MATCHES))
    place = docs.columns.index(text_col)

    def matched(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(at, BATCH_ROWS) for batch in stream for at in range(0, batch.num_rows, BATCH_ROWS)):
            leaks = search(sent.value, part.column(place).to_pylist(), q) if len(sent.value.hashes) else [[]] * part.num_rows
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(leaks, found_type)], part.schema.names)
            tidy()

    return result.mapInArrow(matched, result.schema)


def leak_rows(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """One row for each row and place of an item: doc_id, item_id, start, end, edits, similarity."""
    rows = found.select(F.col(id_col).alias("doc_id"), F.explode("leaks").alias("leak"))
    similarity = 1 - F.col("leak.edits") / F.col("leak.chars")
    return rows.select("doc_id", "leak.item_id", F.col("leak.start").alias("start"), F.col("leak.end").alias("end"), F.col("leak.edits").alias("edits"), similarity.alias("similarity"))
