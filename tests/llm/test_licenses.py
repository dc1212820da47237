import random

import duckdb
import pandas as pd

from metasift.llm import licenses

TEXTS = [
    None,
    "",
    "...",
    "GNU General Public License",
    "gnu\ngeneral  public-license gnu general public license",
    "Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.",
    "mit license mit license mit",
    "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0",
    "Kcc by; İmit license",
    "permission is hereby granted free of charge to any person who obtains a copy of this software",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: x",
    "word " * 50_000 + "apache license",
    "/* Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated files */",
    "Redistribution and use in source and binary forms, with or\n# without modification, are permitted provided that\n# the following conditions are met:",
    "released " + "word " * 9 + "under the mit " + "word " * 9 + "license",
    "the license of the mit under word released",
    "under " * 3000 + "released under a the mit license " + "the license " * 3000,
    "K released under the mit license " * 40,
]


def test_equals_every_block_against_every_template(spark, documents):
    rows = list(enumerate(TEXTS)) + [(5, TEXTS[5]), (None, TEXTS[4])]
    found = licenses.digest(licenses.scan_licenses(documents(rows)))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    expected = con.sql(licenses.digest_sql())
    order = sorted(expected.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(found.columns) == order
    assert sorted((tuple(r[c] for c in order) for r in found.collect()), key=key) == sorted((tuple(r) for r in expected.select(*order).fetchall()), key=key)


def test_labels_of_the_method(documents):
    rows = {r.doc_id: r for r in licenses.digest(licenses.scan_licenses(documents(list(enumerate(TEXTS))))).collect()}
    assert rows[5].labels == "gpl,gpl-work,mit,mit-notice"
    assert (rows[7].base_labels, rows[7].labels) == ("cc-by", "cc-by,cc-by-nc")
    assert rows[10].labels == "bsd" and 0.9 <= rows[10].score <= 1
    assert rows[12].labels == "mit-grant" and rows[13].labels == "bsd"
    assert rows[14].labels == "" and rows[15].labels == "mit-notice"
    assert (rows[6].n_base, rows[6].first_word, rows[6].last_word) == (2, 0, 2)
    assert (rows[0].n_words, rows[0].first_word, rows[0].score) == (0, None, 0.0)


def test_random_texts_of_template_words(documents):
    """Texts that are near the bounds: parts of templates, shuffled, spread out and with words left out."""
    draw, rows = random.Random(2), []
    for i in range(400):
        words = draw.choice(licenses.TEMPLATES)[1].split()
        for _ in range(draw.randint(0, 3)):
            words.pop(draw.randrange(len(words)))
        for _ in range(draw.randint(0, 5)):
            words.insert(draw.randrange(len(words) + 1), draw.choice(["x", "the", "license", "\n", "of"]))
        if draw.random() < 0.2:
            draw.shuffle(words)
        rows.append((i, " ".join([*draw.choice(licenses.TEMPLATES)[1].split()[: draw.randint(0, 6)], *words])))
    found = licenses.digest(licenses.scan_licenses(documents(rows)))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    order = sorted(found.columns)
    expected = sorted(con.sql(licenses.digest_sql()).select(*order).fetchall())
    got = sorted(tuple(r[c] for c in order) for r in found.collect())
    assert [r[:-2] for r in got] == [r[:-2] for r in expected]
    assert got == expected
    assert 100 < sum(r[order.index("labels")] != "" for r in got) < 400


def test_empty_table(documents):
    assert licenses.scan_licenses(documents([])).collect() == []


def test_plan_is_native(documents):
    plan = licenses.scan_licenses(documents([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_on_the_tables(same_as_sql):
    from metasift.llm import queries

    same_as_sql(queries.op4_licenses, queries.oracle_sql()["op4_licenses"])
