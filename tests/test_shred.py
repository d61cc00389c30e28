"""Nested records into flat tables, against a plain recursive walk."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.operators import shred
from quillstone.runtime import table

DRIFT = [
    {"parts": [{"itemName": "a"}, {"itemName": None}, {"item_name": "b", "components": [{"itemName": "c"}, {}, {"itemName": "d"}]}]},
    {"data": {"response": {"parts": {"lines": [{"itemName": "a"}]}, "previous": {"parts": [{"itemName": "old"}]}}}},
    [{"payment_details": {"method": "Cash"}, "delivery_details": [{"address": "12 High St", "date": "x"}, {"address": {"street": None, "city": ""}, "carrier": "y"}]}],
    {"parts": json.dumps([{"itemName": "js"}]), "paymentDetails": json.dumps({"method": " "})},
    {"parts": {"0": {"sku": "k"}, "1": {"sku": "l", "components": {"itemName": "one"}}}},
    {"parts": [[None], [{"quantity": 2}]], "deliveryDetails": {"shipments": [{"trackingNumber": "t"}]}},
    {"parts": {"pages": [{"page": 1, "items": [{"unit": "ea"}, None]}, {"page": 2, "items": [{"unit": "kg"}]}]}},
    {"metadata": {}, "previous": {"parts": [{"itemName": "old"}]}},
]
WANT = {
    0: {("part", -1, 0), ("part", -1, 1), ("component", 1, 0), ("component", 1, 1)}, 1: {("part", -1, 0)}, 2: {("payment", -1, 0), ("delivery", -1, 0), ("delivery", -1, 1), ("address", 0, 0)}, 3: {("part", -1, 0)},
    4: {("part", -1, 0), ("part", -1, 1), ("component", 1, 0)}, 5: {("part", -1, 0), ("delivery", -1, 0)}, 6: {("part", -1, 0), ("part", -1, 1)}, 7: set(),
}


def test_shapes(spark):
    rows = [(i, json.dumps(p)) for i, p in enumerate(DRIFT)] + [(90, json.dumps(json.dumps(DRIFT[0]))), (91, "﻿ " + json.dumps(DRIFT[1]) + "\n")]
    rows += [(80, None), (81, ""), (82, '{"parts": [{"itemName": "cut'), (83, "[" * 5000 + "]" * 5000), (84, '{"parts": []} trailing'), (85, "NaN")]
    df = spark.createDataFrame(rows, "record_id long, payload string").withColumn("child", F.lit("clash"))
    got = {}
    for r in shred.shred_json(df, "record_id", "payload", values=False).collect():
        got.setdefault(r.rec_id, set()).add((r.child, r.parent_pos, r.pos))
    for i, want in WANT.items():
        assert got.get(i, set()) == want, i
    assert got[90] == WANT[0] and got[91] == WANT[1]
    assert not any(i in got for i in range(80, 86))


def test_values_and_links(spark):
    df = spark.createDataFrame([(1, json.dumps(DRIFT[0]))], "id long, j string")
    flat = shred.shred_json(df, "id", "j")
    part = {r.pos: r.item_name for r in shred.child_table(flat, "part").collect()}
    comp = {(r.parent_pos, r.pos): r.item_name for r in shred.child_table(flat, "component").collect()}
    assert part == {0: "a", 1: "b"} and comp == {(1, 0): "c", (1, 1): "d"}
    with pytest.raises(ValueError):
        shred.child_table(flat, "nothing")


def test_empty_table(spark):
    assert shred.shred_json(spark.createDataFrame([], "id long, j string"), "id", "j").count() == 0


def filled(v):
    if isinstance(v, dict):
        return any(filled(x) for x in v.values())
    if isinstance(v, list):
        return any(filled(x) for x in v)
    return bool(v.strip()) if isinstance(v, str) else v is not None


def test_typed_against_walk(spark, sf):
    r = table(spark, sf, "responses")
    got = {tuple(x) for x in shred.shred_responses(r, values=False).distinct().collect()}
    want = set()
    for x in r.select("response_id", "parts", "payment_details", "delivery_details").collect():
        d = x.asDict(recursive=True)
        want |= {(x[0], "part", -1, i) for i in range(sum(filled(p) for p in d["parts"] or []))}
        for c, k in (("payment", "payment_details"), ("delivery", "delivery_details")):
            if filled(d[k]):
                want.add((x[0], c, -1, 0))
        if d["delivery_details"] and filled(d["delivery_details"]["address"]):
            want.add((x[0], "address", 0, 0))
    assert got == want


def test_found_is_distinct(spark, sf):
    f = shred.found(table(spark, sf, "responses"), table(spark, sf, "raw_responses"))
    assert f.columns == ["src", "rec_id", "child", "parent_pos", "pos"]
    assert f.count() == f.distinct().count() > 0
