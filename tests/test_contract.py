import json
import random

import pytest

from tidewright.operators.contract import check_contract, contract_errors

CONTRACT = {
    "type": "object",
    "required": ["station", "samples"],
    "properties": {
        "station": {"const": 7},
        "label": {"type": ["string", "null"]},
        "unit": {"enum": ["mm", "inch"]},
        "place": {"type": "object", "properties": {"height": {"type": "number"}, "indoor": {"type": "boolean"}}},
        "samples": {"type": "array", "items": {"$ref": "#/$defs/sample"}},
    },
    "$defs": {
        "sample": {
            "type": "object",
            "required": ["at"],
            "properties": {"at": {"type": "string"}, "rain": {"type": "integer"}, "flags": {"type": "array", "items": {"type": "string"}}},
        }
    },
}

CASES = [
    ({"station": 7, "samples": []}, []),
    ({"samples": []}, ["$: missing required key 'station'"]),
    ({"station": 8, "samples": []}, ["$.station: expected 7, got 8"]),
    ({"station": "7", "samples": []}, ["$.station: expected 7, got '7'"]),
    ({"station": 7, "samples": [], "label": None, "unit": "ell"}, ["$.unit: 'ell' not one of ['mm', 'inch']"]),
    ({"station": 7, "samples": [], "label": 3}, ["$.label: expected string/null, got int"]),
    ({"station": 7, "samples": {}}, ["$.samples: expected array, got dict"]),
    ({"station": 7, "samples": [], "place": [{"height": "x"}]}, ["$.place: expected object, got list"]),
    (
        {"station": 7, "samples": [], "place": {"height": True, "indoor": 1}},
        ["$.place.height: expected number, got bool", "$.place.indoor: expected boolean, got int"],
    ),
    ({"station": 7, "samples": [], "place": {"height": 1.5}}, []),
    (
        {"station": 7, "samples": [{"at": "6h"}, {"rain": 1.5}, "dry", {"at": 6, "flags": ["ok", 2, None]}]},
        [
            "$.samples[1]: missing required key 'at'",
            "$.samples[1].rain: expected integer, got float",
            "$.samples[2]: expected object, got str",
            "$.samples[3].at: expected string, got int",
            "$.samples[3].flags[1]: expected string, got int",
            "$.samples[3].flags[2]: expected string, got NoneType",
        ],
    ),
    ([1], ["$: expected object, got list"]),
    (None, ["$: expected object, got NoneType"]),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(CASES)], "i int, doc string")
    got = {r.i: r.errors for r in check_contract(df, "doc", CONTRACT).collect()}
    alone = {r.i: r.e for r in df.select("i", contract_errors("doc", CONTRACT).alias("e")).collect()}
    for i, (doc, expected) in enumerate(CASES):
        assert sorted(got[i]) == sorted(expected), doc
        assert alone[i] == got[i]
    assert check_contract(df.withColumn("errors", df.i), "doc", CONTRACT).columns == ["i", "doc", "errors"]


def test_broken_text_and_odd_names(spark):
    df = spark.createDataFrame([("{bad",), (None,), ('{"a b\'c": 1, "x.y": "s"}',)], "doc string")
    contract = {"properties": {"a b'c": {"type": "string"}, "x.y": {"type": "integer"}, "'\"?": {"type": "null"}, "": {}}}
    got = [r.errors for r in check_contract(df, "doc", contract).collect()]
    assert got[0] == got[1] == ["$: not valid JSON"]
    assert sorted(got[2]) == ["$.a b'c: expected string, got int", "$.x.y: expected integer, got str"]


def test_circular_reference_is_refused(spark):
    df = spark.createDataFrame([("{}",)], "doc string")
    loop = {"$ref": "#/$defs/a", "$defs": {"a": {"properties": {"next": {"$ref": "#/$defs/a"}}}}}
    with pytest.raises(ValueError, match="refers to itself"):
        check_contract(df, "doc", loop)


def test_random_values_against_plain_rules(spark):
    rng = random.Random(5)
    pool = [1, -3, 0, 1.0, 2.5, 1e30, "s", "", "1", True, False, None, [], [1], {}, {"k": 1}]
    docs = [{"v": rng.choice(pool)} for _ in range(60)]
    names = {"integer": int, "string": str, "boolean": bool, "null": type(None), "array": list, "object": dict}
    for wanted, py in names.items():
        df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, doc string")
        got = {r.i: r.errors for r in check_contract(df, "doc", {"properties": {"v": {"type": wanted}}}).collect()}
        for i, d in enumerate(docs):
            ok = isinstance(d["v"], py) and not (wanted == "integer" and isinstance(d["v"], bool))
            assert (got[i] == []) == ok, (wanted, d, got[i])
