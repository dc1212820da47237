import hashlib
import random
import zlib

import pytest

from metasift.llm import fingerprints as fp

MASK = (1 << 64) - 1


def plain_fingerprint(text):
    """Byte by byte, with Python's own numbers."""
    data = text.encode()
    golden = int(fp.MULTIPLIER)
    after = []
    for i in range(len(data)):
        mixed = sum((data[i - k] + 1) * pow(golden, k + 1, 1 << 64) for k in range(min(7, i + 1)))
        after.append(((mixed * golden & MASK) >> 32) + 1)
    pieces = lambda b: sum(a % b == 0 for a in after)
    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and pieces(block) < 32:
        block //= 2

    def signature(b):
        out, start = "", 0
        for i, a in enumerate(after):
            if a % b == 0 and len(out) < 63:
                out += fp.ALPHABET[zlib.crc32(data[start : i + 1]) % 64]
                start = i + 1
        return out + fp.ALPHABET[zlib.crc32(data[start:]) % 64] if start < len(data) else out

    return f"{block}:{signature(block)}:{signature(2 * block)}"


def plain_likeness(a, b):
    if a == b:
        return 1.0
    best = 0.0
    (x, *xs), (y, *ys) = a.split(":"), b.split(":")
    for size, s in zip((int(x), 2 * int(x)), xs):
        for other, t in zip((int(y), 2 * int(y)), ys):
            if size != other or not (s or t):
                continue
            if s == t:
                best = 1.0
                continue
            run = max(2, min(7, min(len(s), len(t)) // 4))
            if not any(s[i : i + run] in t for i in range(len(s) - run + 1)):
                continue
            table = [[0] * (len(t) + 1) for _ in range(len(s) + 1)]
            for i, c in enumerate(s):
                for j, d in enumerate(t):
                    table[i + 1][j + 1] = table[i][j] + 1 if c == d else max(table[i][j + 1], table[i + 1][j])
            best = max(best, 2 * table[-1][-1] / (len(s) + len(t)))
    return best


def brute(rows):
    """Rows (id, text) with different ids or texts, each next to the following one; null ids last."""
    out = []
    for k, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, mixed = plain_fingerprint(text), plain_fingerprint(changed)
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, mixed, round(plain_likeness(own, mixed), 9), round(plain_likeness(own, plain_fingerprint(following)), 9)))
    return out


def found(df):
    rows = df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    return [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in rows]


def odd_texts(prose):
    texts = prose(60, seed=5, words=300)
    return [*texts, *texts[:6], "", None, "x", "xy", "é", "日本語のテキスト", "a" * 500, "ab " * 400, "line of words\n" * 200, texts[0] + " " + texts[1], texts[0] + "!"]


def test_like_brute_force(spark, documents, prose):
    texts = odd_texts(prose)
    random.Random(2).shuffle(texts)
    rows = list(enumerate(texts, -3))
    got = found(fp.fingerprint_documents(documents(rows).repartition(5)))
    assert sorted(got) == sorted(brute(rows[::-1]))


def test_long_text_in_stretches(prose, monkeypatch):
    text = " ".join(prose(40, seed=9, words=200)) + "日本語"
    whole = fp.fingerprint(text)
    assert whole == plain_fingerprint(text)
    for stretch in (5, 64, 1000):
        monkeypatch.setattr(fp, "STRETCH", stretch)
        assert fp.fingerprint(text) == whole


def test_very_long_text(prose):
    text = "".join(prose(300, seed=1, words=400)) * 20
    assert fp.likeness(fp.fingerprint(text), fp.fingerprint(text[:-10] + "other end")) > 0.9
    block, first, second = fp.fingerprint("same words again " * 100_000).split(":")
    assert len(first) <= 64 and len(second) <= 64


def test_edits_are_local(prose):
    """An insertion near the front leaves most of the signature as it is; unrelated texts have nothing in common."""
    texts = prose(40, seed=3, words=600)
    for text in texts:
        assert fp.likeness(fp.fingerprint(text), fp.fingerprint(text[:100] + "inserted words " + text[100:])) > 0.8
    halves = [fp.likeness(fp.fingerprint(a), fp.fingerprint(fp.edited(a, b))) for a, b in zip(texts, texts[1:])]
    others = [fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) for a, b in zip(texts, texts[1:])]
    assert min(halves) > 0.3 and max(others) < 0.3


def test_likeness_bounds(prose):
    marks = [fp.fingerprint(t or "") for t in odd_texts(prose)]
    draw = random.Random(4)
    for _ in range(300):
        a, b = draw.choice(marks), draw.choice(marks)
        assert 0 <= fp.likeness(a, b) == fp.likeness(b, a) <= 1
        assert fp.likeness(a, b) == pytest.approx(plain_likeness(a, b))


def test_repeated_and_null_ids(spark, documents):
    """Ids that repeat follow each other by their texts; equal rows give equal results, whichever comes first; null ids come last."""
    rows = [(5, "twice the same row " * 9)] * 40 + [(5, "another text of that id " * 9), (7, "before all " * 9), (None, "no id"), (None, None)]
    a, b = (sorted(map(str, found(fp.fingerprint_documents(d)))) for d in (documents(rows).repartition(7), documents(rows[::-1]).coalesce(1)))
    assert a == b and len(a) == len(rows)
    first = next(r for r in found(fp.fingerprint_documents(documents(rows))) if r[0] == 7)
    assert first[2] != hashlib.sha256(b"").hexdigest()


def test_one_row_and_none(spark, documents):
    (only,) = found(fp.fingerprint_documents(documents([(1, "alone in the table, and its own next")])))
    assert only[6] == 1.0
    assert found(fp.fingerprint_documents(documents([(1, "x")]).where("false"))) == []
    (nothing,) = found(fp.fingerprint_documents(documents([(None, None)])))
    assert nothing[:2] == (None, 0) and nothing[3] == "3::"
