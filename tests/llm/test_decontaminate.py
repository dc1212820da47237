import random
import time

import pytest

from metasift.llm import decontaminate as D


def edit_distance_inside(unit, text):
    """Fewest edits between a unit and any part of a text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(unit, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def edited(text, edits, draw):
    chars = list(text)
    for _ in range(edits):
        at = draw.randrange(len(chars))
        kind = draw.randrange(3)
        if kind == 0:
            chars[at] = draw.choice("xyz")
        elif kind == 1:
            del chars[at]
        else:
            chars.insert(at, draw.choice("xyz"))
    return "".join(chars)


def test_alignment_equals_plain_dynamic_programming():
    draw = random.Random(0)
    for _ in range(200):
        text = "".join(draw.choice("abc ") for _ in range(draw.randint(1, 60)))
        unit = "".join(draw.choice("abc ") for _ in range(draw.randint(1, 30)))
        codes = [D.np.frombuffer(x.encode("utf-32-le"), "<u4") for x in (unit, text)]
        best = edit_distance_inside(unit, text)
        assert D.align(*codes, best - 1) is None
        edits, start, end = D.align(*codes, best)
        assert edits == best
        assert edit_distance_inside(unit, text[start:end]) == best


@pytest.fixture(scope="module")
def items():
    draw = random.Random(9)
    stock = ["".join(draw.choice("bdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 4))) for _ in range(400)]
    return [(i, " ".join(draw.choice(stock) for _ in range(draw.randint(8, 60))).capitalize() + ".") for i in range(12)]


def test_equals_brute_force_over_units(items, prose):
    """The q-gram filter loses no unit that alignment over the whole text would accept."""
    draw = random.Random(3)
    index = D.build_index(items)
    texts = prose(10, words=200)
    for item in range(12):
        words = texts[item % 10].split()
        passage = edited(items[item][1], draw.randint(0, 14), draw)
        texts.append(" ".join([*words[:20], passage, *words[20:]]))
    found = D.search(index, texts)
    for text, leaks in zip(texts, found):
        codes = D.reduce_text(text)[0]
        expected = {int(index.item[u]) for u in range(len(index.item)) if D.align(index.unit(u), codes, int(index.edits[u])) is not None}
        assert {leak["item_id"] for leak in leaks} == expected


def test_every_copy_is_a_span(items):
    text = f"Before. {items[3][1]} Between them. {items[3][1].upper()} {items[3][1]} After {items[4][1]}"
    leaks = D.search(D.build_index(items), [None, text, "", items[3][1]])
    places = [(leak["item_id"], text[leak["start"] : leak["end"]].lower() + ".") for leak in leaks[1]]
    assert places == [(3, items[3][1].lower())] * 3 + [(4, items[4][1].lower())]
    assert [len(x) for x in leaks] == [0, 4, 0, 1]


def test_an_edited_copy_beside_an_exact_one(items):
    draw = random.Random(5)
    long = max(items, key=lambda x: len(x[1]))
    for _ in range(10):
        text = f"one {edited(long[1], 4, draw)} two {long[1]} three " + "four " * 300 + f"{edited(long[1], 4, draw)} end"
        leaks = D.search(D.build_index(items), [text])[0]
        assert {leak["item_id"] for leak in leaks} == {long[0]}
        covered = sum(leak["end"] - leak["start"] for leak in leaks)
        assert 2.7 * len(long[1]) < covered < 3.1 * len(long[1])


def test_windows_of_few_qgrams_find_the_same(items, prose, monkeypatch):
    draw = random.Random(8)
    texts = [" ".join(f"{p} {edited(items[draw.randrange(12)][1], draw.randint(0, 10), draw)}" for p in prose(6, seed=k)) for k in range(6)]
    index = D.build_index(items)
    whole = D.search(index, texts)
    monkeypatch.setattr(D, "WINDOW_ENTRIES", 50)
    monkeypatch.setattr(D, "PAIRS", 3)
    parts = D.search(index, texts)
    assert [{x["item_id"] for x in a} for a in parts] == [{x["item_id"] for x in a} for a in whole]
    assert [[(x["start"], x["end"]) for x in a] for a in parts] == [[(x["start"], x["end"]) for x in a] for a in whole]


@pytest.mark.parametrize("text", ["ab " * 333_000, "ab " * 100_000 + "xab ab" * 50 + " ab" * 100_000])
def test_a_long_repetitive_text(text):
    began = time.process_time()
    leaks = D.search(D.build_index([(7, "ab " * 100)]), [text])[0]
    assert time.process_time() - began < 10
    assert leaks and leaks[0]["start"] == 0 and leaks[-1]["end"] == len(text.rstrip())


def test_names_that_clash(spark, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {items[0][1]}", 2, 3)], "doc_id long, text string, Leaks int, leaks_before int")
    found = D.find_leaks(docs, benchmark)
    assert found.columns == ["doc_id", "text", "Leaks_before1", "leaks_before", "leaks"]
    assert [len(r.leaks) for r in found.collect()] == [1]


def test_spans(items):
    text = "Some words before. " + items[3][1].upper().replace(" ", "  ") + " And after."
    leak = D.search(D.build_index(items), [text])[0][0]
    assert leak["item_id"] == 3 and leak["edits"] == 0
    assert text[leak["start"] : leak["end"]] == items[3][1].upper().replace(" ", "  ").rstrip(".")


def test_operator(spark, documents, items, prose):
    clean = prose(20, seed=5, words=80)
    rows = [(i, t) for i, t in enumerate(clean)] + [(100, f"x {items[0][1]} y"), (101, f"{items[1][1]} {items[2][1]}"), (101, items[1][1]), (102, None), (103, ""), (104, "word " * 60_000 + items[5][1])]
    benchmark = spark.createDataFrame([*items, (50, None), (51, ""), (52, "tiny"), (None, "without an id it is no item at all")], "item_id long, text string")
    docs = documents(rows)
    found = D.find_leaks(docs, benchmark)
    assert found.columns == [*docs.columns[:10], "leaks_before", *docs.columns[11:], "leaks"]
    assert found.count() == len(rows)
    leaks = sorted((r.doc_id, r.item_id, r.edits) for r in D.leak_rows(found).collect())
    assert leaks == [(100, 0, 0), (101, 1, 0), (101, 1, 0), (101, 2, 0), (104, 5, 0)]


def test_blocks_give_the_same(spark, documents, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents([(i, f"a {t} b") for i, t in items])
    one = sorted(map(tuple, D.leak_rows(D.find_leaks(docs, benchmark)).collect()))
    assert sorted(map(tuple, D.leak_rows(D.find_leaks(docs, benchmark, block_chars=800)).collect())) == one


def test_part_of_an_item(items):
    long = max(items, key=lambda x: len(x[1]))
    half = long[1][: len(long[1]) // 2 + 60]
    assert [x["item_id"] for x in D.search(D.build_index(items), [f"pre {half} post"])[0]] == [long[0]]


def test_empty_tables(spark, documents, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert D.find_leaks(documents([]), benchmark).collect() == []
    assert D.leak_rows(D.find_leaks(documents([(1, "x")]), benchmark.where("false"))).collect() == []


def test_repeated_item_rows_count_once(spark, documents, items):
    docs = documents([(1, f"before {items[0][1]} after"), (2, "nothing of it")])
    once, twice = (spark.createDataFrame(rows, "item_id long, text string") for rows in (items, items + items))
    assert D.find_leaks(docs, twice).select("doc_id", "leaks").collect() == D.find_leaks(docs, once).select("doc_id", "leaks").collect()


def test_short_excerpts_at_any_offset():
    """An excerpt of 60 characters and one word more is found wherever in the item it begins."""
    draw = random.Random(11)
    stock = ["".join(draw.choice("bdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 4))) for _ in range(400)]
    words = lambda n: " ".join(draw.choice(stock) for _ in range(n))
    items = [(i, words(60)) for i in range(6)]
    index = D.build_index(items)
    for number, text in items:
        excerpts = [text[at : at + 80] for at in range(0, len(text) - 80, 7)]
        found = D.search(index, [f"{words(30)} {e} {words(30)}" for e in excerpts])
        assert [[leak["item_id"] for leak in leaks] for leaks in found] == [[number]] * len(excerpts)


def test_blocks_are_jobs_of_their_own(spark, documents, items):
    """No plan holds more than one block's search, so no task holds more than one block's index."""
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents([(i, f"a {t} b") for i, t in items] + [(0, items[1][1]), (None, None)])
    many = D.find_leaks(docs, benchmark, block_chars=300)
    assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 0
    one = D.find_leaks(docs, benchmark)
    key = lambda rows: sorted(str((r.doc_id, r.text, sorted(r.leaks))) for r in rows)
    assert many.columns == one.columns and key(many.collect()) == key(one.collect())
