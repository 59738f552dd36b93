"""Canonical JSON: the forms of RFC 8785, and what has none."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from turnwise.operators.feeds import canonical_digest, canonical_json


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("[1e-5, 1e-6, 1e-7, 1.5e-9]", "[0.00001,0.000001,1e-7,1.5e-9]"),
        ("[1e20, 1e21, 123456789012345680000.0, 1.25e300]", "[100000000000000000000,1e+21,123456789012345680000,1.25e+300]"),
        ("[-0, -0.0, 0.10, -2.50, 333333333.33333329]", "[0,0,0.1,-2.5,333333333.3333333]"),
        ("[9007199254740992, -9007199254740992]", "[9007199254740992,-9007199254740992]"),
        ('{"b": true, "a": null, "\\u20ac": "\\u0007\\n\\"", "\\ud83d\\ude00": [], "\\ufb33": {}}', '{"a":null,"b":true,"€":"\\u0007\\n\\"","😀":[],"\ufb33":{}}'),
        ('{"x": 1, "x": 2}', '{"x":2}'),
        ('"\\u2028é"', '" é"'),
    ],
)
def test_forms(text, form):
    assert canonical_json(json.loads(text)) == form


def test_digests_and_refusals(spark):
    bad = ["9007199254740993", "[-9007199254740993]", '"\\ud800"', '{"\\udfff": 1}', "NaN", "[Infinity]", "[" * 3000 + "]" * 3000, "{", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(['{"b":1.0,"a":[]}', *bad])], "i int, t string")
    got = {r.i: r.d for r in rows.select("i", canonical_digest(F.col("t")).alias("d")).collect()}
    assert got.pop(0) == hashlib.sha256(b'{"a":[],"b":1}').hexdigest()
    assert set(got.values()) == {None} and len(got) == len(bad)
