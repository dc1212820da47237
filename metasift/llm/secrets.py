"""Secret scan: plain patterns, and runs that a tokenizer needs many tokens for.

Random strings cost about one token for every one or two characters, while words, paths and
identifiers cost far fewer. A run is reported as ``dense`` when it has letters, isn't a known
digest, UUID or number-like identifier, and averages at most ``max_ratio`` characters a token (at
most 2.1 where it has no digit, as long words come near the usual bound). Digits alone count where 20 or more stand together. Readable words in a run dilute that average, so where the whole run is above
it, its stretches are measured: the pieces between separators, and every window of whole tokens
with at least 20 characters. What a plain pattern has reported is cut out of a run first.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the query's contract, in this order.
KINDS = ("assign", "access", "hex", "dense")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
#: A longest run with at least 24 characters is what [0-9a-f]+ finds once its short matches are dropped.
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
KEYWORD = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
DIGEST = re.compile(r"[0-9a-fA-F]+")
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
LETTER, DIGIT, LONG_NUMBER = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]"), re.compile(r"[0-9]{20,}")
LEAST = 20
LETTERS_RATIO = 2.1
#: Pieces that stand together are measured by those with a letter, without what is between them: words of paths, file names and
#: other languages need fewer tokens than that (see README), pieces of a random string more. So many characters must be measured.
JOINED_RATIO, JOINED_LEAST = 1.65, 12
#: Pieces of a run, and identifiers that stand between separators.
PART = re.compile(r"[A-Za-z0-9]+")
KNOWN = re.compile(rf"(?<![A-Za-z0-9])(?:{UUID.pattern}|{'|'.join(f'[0-9a-fA-F]{{{n}}}' for n in sorted(DIGEST_LENGTHS))})(?![A-Za-z0-9])")
#: Runs are measured in pieces of this many characters, so a huge run stays linear.
PIECE = 512

SPANS = "array<struct<kind:string,start:int,end:int,ratio:double>>"


@lru_cache(maxsize=2)
def _encoding(ranks_path: str):
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_lengths(run: str, ranks_path: str) -> list[int]:
    encoding = _encoding(ranks_path)
    tokens = (t for i in range(0, len(run), PIECE) for t in encoding.encode_ordinary(run[i : i + PIECE]))
    return [len(encoding.decode_single_token_bytes(t)) for t in tokens]


def is_known_identifier(run: str) -> bool:
    """A digest of a usual length, a UUID, or digits in pieces that are each too short to be a secret, as dates and numbers are."""
    if UUID.fullmatch(run):
        return True
    if not LETTER.search(run):
        return not LONG_NUMBER.search(run)
    return len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run) is not None


def is_dense(run: str, ratio: float, max_ratio: float) -> bool:
    return ratio <= (max_ratio if DIGIT.search(run) else min(max_ratio, LETTERS_RATIO)) and not is_known_identifier(run)


def without(start: int, end: int, cuts: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of a span outside of ``cuts`` (sorted), where it has room for a dense stretch."""
    for a, b in cuts:
        if a >= end:
            break
        if b > start:
            if a - start >= LEAST:
                yield start, a
            start = b
    if end - start >= LEAST:
        yield start, end


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dense_windows(run: str, lengths: list[int], max_ratio: float) -> Iterator[tuple[int, int, float]]:
    """From each token on, the fewest tokens with at least 20 characters, where they are dense."""
    last, start, size = 0, 0, 0
    for first, length in enumerate(lengths):
        while size < LEAST and last < len(lengths):
            size += lengths[last]
            last += 1
        if size < LEAST:
            return
        ratio = size / (last - first)
        if ratio <= max_ratio and is_dense(run[start : start + size], ratio, max_ratio):
            yield start, start + size, ratio
        start, size = start + length, size - length


def joined_windows(part: str, pieces: list[tuple[int, int]], tokens: list[int], max_ratio: float) -> Iterator[tuple[int, int, float]]:
    """From each piece of ``part`` on, the fewest pieces that span at least 20 characters, where those with a letter are dense together.

    The span counts what stands before the first and behind the last piece of the part. A piece that stood a few pieces
    before already isn't measured again: names repeat in paths, random strings don't.
    """
    words = [part[a:b] for a, b in pieces]
    counts = [bool(LETTER.search(w)) and w not in words[max(0, k - 4) : k] for k, w in enumerate(words)]
    begins = [0 if k == 0 else a for k, (a, _) in enumerate(pieces)]
    ends = [len(part) if k == len(pieces) - 1 else b for k, (_, b) in enumerate(pieces)]
    last, chars, counted = 0, 0, 0
    for first in range(len(pieces)):
        while last < len(pieces) and (last <= first or ends[last - 1] - begins[first] < LEAST):
            if counts[last]:
                chars, counted = chars + len(words[last]), counted + tokens[last]
            last += 1
        if ends[last - 1] - begins[first] < LEAST:
            return
        if (last > first + 1 or len(words[first]) < LEAST) and chars >= JOINED_LEAST and chars <= min(max_ratio, JOINED_RATIO) * counted:
            yield pieces[first][0], pieces[last - 1][1], chars / counted
        if counts[first]:
            chars, counted = chars - len(words[first]), counted - tokens[first]


def dense_stretches(run: str, ranks_path: str, max_ratio: float) -> Iterator[tuple[int, int, float]]:
    """Start, end and characters a token of the dense stretches of a run: its long pieces or windows of them, and pieces that are dense together."""
    if is_known_identifier(run):
        return
    found = []
    for start, end in without(0, len(run), (m.span() for m in KNOWN.finditer(run))):
        part = run[start:end]
        pieces = [m.span() for m in PART.finditer(part)]
        tokens = []
        for a, b in pieces:
            # a piece is measured apart, as its first characters may share a token with what stands before it
            own = token_lengths(part[a:b], ranks_path)
            tokens.append(len(own))
            if b - a >= LEAST:
                ratio = (b - a) / len(own)
                dense = [(0, b - a, ratio)] if is_dense(part[a:b], ratio, max_ratio) else dense_windows(part[a:b], own, max_ratio)
                found += [(start + a + x, start + a + y, r) for x, y, r in dense]
        found += [(start + a, start + b, r) for a, b, r in joined_windows(part, pieces, tokens, max_ratio)]
    whole = PART.search(run)
    edge = len(run) - len(run.rstrip("+/_=-"))
    held: tuple[int, int, float] | None = None
    for a, b, r in [*sorted(found), (len(run) + 1, len(run) + 1, 0.0)]:
        if held and a < held[1]:
            held = (held[0], max(held[1], b), min(held[2], r))
            continue
        if held:
            # padding belongs to what is dense from end to end
            yield (0, len(run), held[2]) if (held[0], held[1]) == (whole.start(), len(run) - edge) else held
        held = (a, b, r)


def scan(text: str, ranks_path: str, max_ratio: float) -> list[dict]:
    found = []
    if KEYWORD.search(text):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    spans = [{"kind": k, "start": a, "end": b, "ratio": None} for k, a, b in found]
    cuts = joined((a, b) for _, a, b in found)
    first = 0
    for m in RUN.finditer(text):
        # runs and cuts both come in order, so each cut is passed once
        while first < len(cuts) and cuts[first][1] <= m.start():
            first += 1
        if is_known_identifier(m[0]):
            continue
        last = first
        while last < len(cuts) and cuts[last][0] < m.end():
            last += 1
        for start, end in without(m.start(), m.end(), cuts[first:last]):
            spans += [{"kind": "dense", "start": start + a, "end": start + b, "ratio": r} for a, b, r in dense_stretches(text[start:end], ranks_path, max_ratio)]
    return sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"])))


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, max_ratio: float = 2.2) -> DataFrame:
    """One row per row of ``docs``: its id and ``spans`` (kind, start, end in code points, characters a token for dense stretches: the least of the windows that a stretch is made of).

    Null and empty texts have no spans; very long texts are scanned whole, in time linear in their length; spans that begin at
    one place are ordered by kind; repeated rows are scanned each; other columns are ignored; an empty table gives an empty one.
    """
    ranks = ranks_path or default_ranks()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("ratio", pa.float64())]))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            spans = [scan(text.as_py(), ranks, max_ratio) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, spans_type)], ["id", "spans"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"id {id_type}, spans {SPANS}").withColumnRenamed("id", id_col)


def described(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns out of ``find_secrets``' rows."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "dense")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        count("dense").alias("n_dense"),
        F.sha2(described(base), 256).alias("base_sha256"),
        described(F.col("spans")).alias("spans"),
    )
