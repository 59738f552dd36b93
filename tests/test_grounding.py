"""Fields held against their text, and numbers in words: literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from turnwise.functions.grounding import date_value, ground_fields, number_value

NUMBERS = {"$1,250.50 off": 1250.5, "-3 degrees": -3.0, "60 days": 60.0, "fifty dollars": 50.0, "two hundred and six thousand": 206_000.0, "one million two hundred thousand and five": 1_200_005.0, "a hundred": None, "nineteen ninety": 109.0, "forty-two, then nine": 42.0, "zero": 0.0, "thousand": None, "none at all": None, "": None, None: None}


def test_numbers(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(NUMBERS)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", number_value(F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(len(NUMBERS))] == list(NUMBERS.values())


@pytest.mark.parametrize(("text", "value"), [("2024-3-9", "2024-03-09"), ("3/9/2024", "2024-03-09"), ("march 9, 2024", "2024-03-09"), ("2024-02-30", None), ("soon", None)])
def test_dates(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(date_value(F.col("t"))).first()[0] == value


TEXT = "I paid fifty dollars on 3/9/2024 to Acme, card 4111 2222 3333 4444, says [REDACTED]"
CASES = [
    ("string", "Acme", None, False, "extracted", "Acme", "Acme"),
    ("string", "ACME", None, False, "ungrounded", None, None),
    ("string", "  ", None, False, "absent", None, None),
    ("string", None, None, False, "absent", None, None),
    ("string", "[REDACTED]", None, False, "withheld_pii", None, None),
    ("string", "4111 2222 3333 4444", None, False, "withheld_pii", None, None),
    ("string", "says", None, False, "withheld_pii", None, None),  # a sensitive value of the call
    ("amount", "fifty dollars", None, False, "extracted", "50.0", "fifty dollars"),
    ("number", "to Acme", None, False, "invalid", None, "to Acme"),
    ("date", "3/9/2024", None, False, "extracted", "2024-03-09", "3/9/2024"),
    ("date", "9 March", None, False, "ungrounded", None, None),
    ("boolean", "true", None, False, "extracted", "true", None),
    ("boolean", "yes", None, False, "invalid", None, None),
    ("boolean", "True", "I paid", True, "extracted", "true", "I paid"),
    ("boolean", "true", "I owe", True, "ungrounded", None, None),
    ("boolean", "true", None, True, "ungrounded", None, None),
    ("enum", "REFUND", "to Acme", True, "extracted", "Refund", "to Acme"),
    ("enum", "refund", "card 4111 2222 3333 4444", True, "withheld_pii", None, None),
    ("enum", "other", None, False, "invalid", None, None),
]


def test_statuses(spark):
    answers = spark.createDataFrame([(1, f"f{i:02}", t, a, e, r, ["Refund", "Return"]) for i, (t, a, e, r, *_) in enumerate(CASES)], "span int, field string, type string, answer string, evidence string, requires_evidence boolean, enum_values array<string>")
    spans = spark.createDataFrame([(1, TEXT, 100, ["says"]), (2, "", 0, None)], "span int, text string, char_start int, sensitive array<string>")
    got = ground_fields(answers, spans, "span", "field").orderBy("field").collect()
    for r, (_, _, _, _, status, value, surface) in zip(got, CASES, strict=True):
        assert (r.status, r.value, r.surface) == (status, value, surface), r
        if surface:
            assert TEXT[r.char_begin - 100 : r.char_end - 100] == surface
        else:
            assert r.char_begin is None and r.char_end is None
    assert ground_fields(answers.where("false"), spans, "span", "field").count() == 0
