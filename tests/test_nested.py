import copy
import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from metasift.operators import nested


def made(draw, depth=3):
    kind = draw.choice(["object", "array", "int", "float", "string", "bool", "null"] if depth else ["int", "float", "string", "bool", "null"])
    if kind == "object":
        return {draw.choice(["a", "b", "key", "p_value", "odd.key", 'q"u', "é"]): made(draw, depth - 1) for _ in range(draw.randint(0, 4))}
    if kind == "array":
        return [made(draw, depth - 1) for _ in range(draw.randint(0, 3))]
    return {"int": draw.randint(-5, 5), "float": draw.choice([0.5, 1.0, -2.25, 1e-13, 3e20]), "string": draw.choice(["x", "", "1", "é\n"]), "bool": draw.random() < 0.5, "null": None}[kind]


def spoilt(draw, value):
    """``value`` with small changes anywhere."""
    if draw.random() < 0.12:
        return made(draw, 1)
    if isinstance(value, dict):
        out = {k: spoilt(draw, v) for k, v in value.items() if draw.random() > 0.06}
        return out | ({"more": 1} if draw.random() < 0.06 else {})
    if isinstance(value, list):
        return [spoilt(draw, v) for v in value] + ([0] if draw.random() < 0.06 else [])
    if isinstance(value, float) and draw.random() < 0.3:
        return value * (1 + draw.choice([1e-12, 1e-7]))
    return value


def step(key):
    return "." + key if key in ("a", "b", "key", "p_value", "more") else '["' + key.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def told(actual, expected, path=""):
    if isinstance(expected, dict):
        if not isinstance(actual, dict):
            return [(path, "kind")]
        out = [(path + step(k), "extra") for k in actual if k not in expected]
        for k, v in expected.items():
            if k != "p_value":
                out += told(actual[k], v, path + step(k)) if k in actual else [(path + step(k), "missing")]
        return out
    if isinstance(expected, list):
        if not isinstance(actual, list):
            return [(path, "kind")]
        if len(actual) != len(expected):
            return [(path, "length")]
        return [d for i, (a, e) in enumerate(zip(actual, expected)) for d in told(a, e, f"{path}[{i}]")]
    if isinstance(expected, float) and isinstance(actual, (int, float)) and not isinstance(actual, bool):
        return [] if math.isclose(actual, expected, rel_tol=1e-9, abs_tol=1e-12) else [(path, "value")]
    if type(actual) is not type(expected):
        return [(path, "kind")]
    return [] if actual == expected else [(path, "value")]


def compared(spark, actual, expected, **options):
    frames = (spark.createDataFrame(rows, "id long, j string").select("id", F.parse_json("j").alias("value"), F.lit(1).alias("path")) for rows in (actual, expected))
    return sorted(((r.id, r.path, r.problem) for r in nested.differences(*frames, "id", "value", **options).collect()), key=str)


def test_like_plain_recursion(spark):
    draw = random.Random(3)
    expected = {i: {"root": made(draw), "list": made(draw, 2)} for i in range(250)}
    actual = {i: spoilt(draw, copy.deepcopy(v)) for i, v in expected.items()}
    rows = lambda values: [(i, json.dumps(v)) for i, v in values.items()]
    want = sorted(((i, p, problem) for i in expected for p, problem in told(json.loads(json.dumps(actual[i])), expected[i])), key=str)
    names = {"root": ".root", "list": ".list"}
    want = [(i, p if not p.startswith('["') else next((names[k] + p[len(k) + 4 :] for k in names if p.startswith(f'["{k}"]')), p), problem) for i, p, problem in want]
    assert len(want) > 100
    assert compared(spark, rows(actual), rows(expected), ignored=("p_value",)) == sorted(want, key=str)


def test_ids_that_cannot_be_compared(spark):
    """Repeated, lone and null ids, null values; equal values of any depth have no rows."""
    deep = "[" * 40 + "1" + "]" * 40
    a = [(1, "{}"), (1, "{}"), (2, "1"), (3, None), (None, "1"), (5, deep), (6, None)]
    e = [(1, "{}"), (3, "[]"), (4, "1"), (None, "2"), (5, deep), (6, None)]
    assert compared(spark, a, e) == [(1, "", "repeated"), (2, "", "absent"), (3, "", "absent"), (4, "", "absent")]
    assert compared(spark, [], []) == []


def test_ignored_keys(spark):
    e = [(1, '{"p":1,"q":{"p":{"deep":1}}}'), (2, '{"q":1}')]
    a = [(1, '{"q":{"p":[2]}}'), (2, '{"q":1,"p":3}')]
    assert compared(spark, a, e, ignored=("p",)) == [(2, ".p", "extra")]


ODD = [
    '{"b":1,"a":{"z":[],"y":{}}}', '{"\U0001f600":1,"￮":2,"é":3}', '[1.0,1e16,1e-5,0.1,-0.0,8.41e21,1E400]', '"\\u001f\\u007f\\n\\/é"', '{"a":1,"a":2}', "NaN", "[Infinity]", "{", "",
    '"\\ud800"', "123456789012345678901234567890", "[" * 100_000, " null ", "[1, 2 ,\t3]", '{"k":' + "9" * 5000 + "}", "5e-324", "true",
]


def test_canonical_text(spark):
    rows = [*enumerate(ODD), (99, None)]
    found = {r.id: r.c for r in nested.canonical_json(spark.createDataFrame(rows, "id long, j string"), "j", "c").collect()}
    assert found.pop(99) is None
    for i, text in enumerate(ODD):
        try:
            want = json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
            digest = hashlib.sha256(want.encode()).hexdigest()
        except (ValueError, RecursionError):
            assert found[i].json is None and found[i].sha256 is None and found[i].problem
        else:
            assert (found[i].json, found[i].sha256, found[i].problem) == (want, digest, None)


def test_canonical_columns(spark):
    df = spark.createDataFrame([(1, [0.5, None], {"b": 1.0, "a": float("nan")}), (2, None, {"b": 1e16}), (3, [float("inf")], None)], "id long, l array<double>, m map<string,double>")
    found = {r.id: r.c for r in nested.canonical_json(df.withColumn("s", F.struct("m", "l")), "s", "c").collect()}
    assert found[1].problem == found[3].problem == "not_a_number"
    assert found[2].json == '{"l":null,"m":{"b":1e+16}}'


def test_variant_is_not_taken(spark):
    with pytest.raises(TypeError):
        nested.canonical_json(spark.range(1).select(F.parse_json(F.lit("1")).alias("v")), "v", "c")
