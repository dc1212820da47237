"""JSON against rules: each fault planted once, odd inputs, and random values against a plain reading of the rules."""

import json
import random

import pytest

from metasift.sources import validated
from metasift.sources.validated import Rule


def load(spark, raws, rules):
    rows = spark.createDataFrame(list(enumerate(raws)), "id long, raw string")
    sound, violations = validated.load(rows, "id", "raw", rules)
    return {r.id for r in sound.collect()}, {(r.id, r.path, r.fault) for r in violations.collect()}


VOTE = {"model": "m", "label": "include", "confidence": 0.5}


@pytest.mark.parametrize(
    ("rules", "value", "faults"),
    [
        (validated.DECISION, {"record_id": "a", "votes": [VOTE, VOTE | {"confidence": 1}]}, set()),
        (validated.DECISION, {"record_id": "a", "votes": [VOTE, VOTE | {"confidence": 1.01, "label": "yes"}]}, {(".votes[1].confidence", "range"), (".votes[1].label", "choice")}),
        (validated.DECISION, {"record_id": 1, "votes": {}}, {(".record_id", "kind"), (".votes", "kind")}),
        (validated.DECISION, {"votes": [{}]}, {(".record_id", "missing"), (".votes[0].model", "missing"), (".votes[0].label", "missing"), (".votes[0].confidence", "missing")}),
        (validated.RECORD, {"record_id": "a", "title": "t", "year": 2020.5, "authors": ["x", None], "other": {"free": 1}}, {(".year", "kind"), (".authors[1]", "kind")}),
        (validated.GOLD, {"gold": {"10.1/a b": True, "c": "false", 'd"e': 1}}, {(".gold.c", "kind"), ('.gold["d\\"e"]', "kind")}),
        (validated.GOLD, [], {("", "kind")}),
        (validated.FORM, {"fields": [{"key": " \t"}, {"key": "ok"}, {"key": 3}, "x"]}, {(".fields[0].key", "blank"), (".fields[2].key", "kind"), (".fields[3]", "kind")}),
        (validated.EFFECTS, {"effects": [{"study_id": "a"}]}, {(".effects", "size")}),
        (validated.CRITERIA, {"criteria": {"population": {"inclusion": []}, "x": 4}}, {(".criteria.x", "kind")}),
    ],
)
def test_rules(spark, rules, value, faults):
    sound, found = load(spark, [json.dumps(value)], rules)
    assert {(path, fault) for _, path, fault in found} == faults
    assert sound == (set() if faults else {0})


def test_what_is_not_json(spark):
    sound, found = load(spark, [None, "", "{", '{"gold": {"a": true, "a": false}}', "null", '{"gold": {}}'], validated.GOLD)
    assert found == {(0, "", "not JSON"), (1, "", "not JSON"), (2, "", "not JSON"), (3, "", "not JSON"), (4, "", "kind")}
    assert sound == {5}


def test_null_and_repeated_ids_are_loaded_each_for_itself(spark):
    rows = spark.createDataFrame([(None, '{"gold": {}}', 1), (None, "{}", 2), (7, "{}", 3), (7, '{"gold": {}}', 4)], "id long, raw string, found long")
    sound, violations = validated.load(rows, "id", "raw", validated.GOLD)
    assert sound.columns == rows.columns
    assert {r.found for r in sound.collect()} == {1, 4}
    assert sorted((str(r.id), r.path, r.fault) for r in violations.collect()) == [("7", ".gold", "missing"), ("None", ".gold", "missing")]


def test_no_rows_long_texts_and_no_required_key(spark):
    assert load(spark, [], validated.GOLD) == (set(), set())
    long = json.dumps({"gold": {f"k{i}": i != 4999 for i in range(5000)} | {"last": "x" * 1_000_000}})
    assert load(spark, [long], validated.GOLD) == (set(), {(0, ".gold.last", "kind")})
    assert load(spark, ["3"], (Rule("", ("float",), high=2.5),)) == (set(), {(0, "", "range")})


def test_first_faults(spark):
    rows = spark.createDataFrame([("a", '{"votes": [{}]}'), ("b", "{")], "id string, raw string")
    found = validated.first_faults(validated.load(rows, "id", "raw", validated.DECISION)[1])
    assert {tuple(r) for r in found.collect()} == {("a", ".record_id", "missing", 3), ("b", "", "not JSON", 0)}


def test_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"gold":\n {"a": true}}')
    (tmp_path / "bad.json").write_text('{"gold":\n {"a": "true"}}')
    sound, violations = validated.load_files(spark, str(tmp_path), validated.GOLD)
    assert [r.path.rsplit("/", 1)[1] for r in sound.collect()] == ["good.json"]
    assert [(r.id.rsplit("/", 1)[1], r.path, r.expected, r.found) for r in violations.collect()] == [("bad.json", ".gold.a", "bool", '"true"')]


def test_only_a_named_key_can_be_required():
    for path in ("", ".gold.*", ".votes[*]"):
        with pytest.raises(ValueError, match="named key"):
            Rule(path, ("object",), True)


def test_random_votes_against_a_plain_reading(spark):
    rng = random.Random(3)
    pick = lambda *values: rng.choice(values)
    raws, expected = [], set()
    for i in range(200):
        votes = []
        for v in range(rng.randrange(4)):
            vote = {"model": pick("m", 5), "label": pick("include", "odd", None), "confidence": pick(0, 0.5, 1, 2, -1, "1", True)}
            for key in list(vote):
                if rng.random() < 0.2:
                    del vote[key]
            place = f".votes[{v}]"
            expected |= {(i, f"{place}.{key}", "missing") for key in ("model", "label", "confidence") if key not in vote}
            if vote.get("model") == 5:
                expected.add((i, f"{place}.model", "kind"))
            if "label" in vote and vote["label"] != "include":
                expected.add((i, f"{place}.label", "kind" if vote["label"] is None else "choice"))
            if "confidence" in vote:
                c = vote["confidence"]
                if isinstance(c, (bool, str)):
                    expected.add((i, f"{place}.confidence", "kind"))
                elif not 0 <= c <= 1:
                    expected.add((i, f"{place}.confidence", "range"))
            votes.append(vote)
        raws.append(json.dumps({"record_id": "r", "votes": votes}))
    sound, found = load(spark, raws, validated.DECISION)
    assert found == expected
    assert sound == set(range(200)) - {i for i, _, _ in expected}
