import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from metasift.llm import interaction
from metasift.llm.queries import op13_filter_audit

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(rows, labels):
    """Rows (id, text, lang); every order is applied to the rows themselves."""
    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in (0, 1))
    failing = []
    for doc, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = doc is not None and any(i is not None and i < doc and (t or "") == text for i, t, _ in rows)
        marks = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), copy]
        failing.append((lang or "", {f for f, m in zip("ABCDE", marks) if m}, doc in good, doc in toxic))
    out, shapley = [], Counter()
    for part in {f[0] for f in failing}:
        for order in itertools.permutations("ABCDE"):
            left = [f for f in failing if f[0] == part]
            for step, name in enumerate(order, 1):
                gone = [f for f in left if name in f[1]]
                left = [f for f in left if name not in f[1]]
                fails = [f for f in failing if f[0] == part and name in f[1]]
                shapley[part, name] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), len(fails) - len(gone), sum(f[1] == {name} for f in fails), sum(f[2] for f in gone), sum(f[3] for f in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def made(n, seed=0):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        words = [draw.choice("abcdefgh") + str(draw.randint(0, draw.choice([40, 9000]))) for _ in range(draw.choice([20, 99, 100, 130]))]
        if draw.random() < 0.3:
            words = [w.upper() * 3 for w in words]
        if draw.random() < 0.3:
            words.append(draw.choice("#$%&*|"))
        rows.append((i, draw.choice([" ", "\t", "\x0b", "  "]).join(words), draw.choice(["en", "de", None, ""])))
    copies = [(n + k, draw.choice(rows)[1], draw.choice(["en", "fr"])) for k in range(n // 2)]
    return rows + copies


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "p", "m", "d", 1) for r in rows], "doc_id long, text string, lang string, part string, mask string, digest string, n int").repartition(4)
    marks = spark.createDataFrame([(*r, "g") for r in labels], "doc_id long, quality int, toxic int, good string")
    return sorted(tuple(r[c] for c in COLUMNS) for r in interaction.audit_filters(docs, marks).collect())


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_all(n):
    order = list(range(n))
    seen = {tuple(order)}
    count = 0
    for i in interaction.swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.add(tuple(order))
        count += 1
    assert len(seen) == count + 1 == math.factorial(n)


def test_like_brute_force(spark):
    rows = made(120)
    draw = random.Random(3)
    labels = [(draw.randint(-5, 190), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(150)] + [(None, 1, 1)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_odd_rows(spark):
    """Null, empty and very long texts, repeated rows and ids, null ids with a text that others have."""
    rows = made(30, seed=2)
    rows += [(500, None, "en"), (501, "", "en"), (502, "", None), (None, "", "en"), (None, rows[0][1], "en"), rows[0], rows[0], rows[40], (7, rows[3][1], "de"), (600, "long words " * 200_000, "xx"), (600, "long words " * 200_000, "xx"), (601, "long words " * 200_000, "xx")]
    assert audited(spark, rows, [(500, 1, 1), (600, 1, 0), (601, 0, 1)]) == brute(rows, [(500, 1, 1), (600, 1, 0), (601, 0, 1)])


def test_only_copies(spark):
    rows = [(i, "one text for all", "en") for i in range(2000)]
    found = audited(spark, rows, [])
    assert next(r for r in found if r[1] == "EABCD" and r[2] == 1)[3:6] == (1, 1999, 0)


def test_empty(spark):
    assert audited(spark, [], []) == []


def test_shares_add_up():
    """Over all filters the Shapley shares are what all filters remove together, times the number of orders."""
    cells = np.random.default_rng(1).integers(0, 50, (3, 32, 3))
    batch = interaction.audit_cells(["x", "y", "z"], cells).to_pydict()
    for k, part in enumerate("xyz"):
        shares = {(o[s - 1], v) for p, o, s, v in zip(batch["part"], batch["filter_order"], batch["step"], batch["shapley"]) if p == part}
        assert len(shares) == 5
        assert sum(v for _, v in shares) == math.factorial(5) * int(cells[k, 1:, 0].sum())


def test_query_like_sql(same_as_sql):
    same_as_sql(op13_filter_audit, interaction.AUDIT_SQL)
