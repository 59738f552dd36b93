"""Python helpers and general operators on literal cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions.masking import consistent_mask, find_spans, mask_by_position, spans
from turnwise.functions.scalars import any_date
from turnwise.functions.text import sequence_ratio, word_errors
from turnwise.operators.graph import closure
from turnwise.operators.intervals import merge_intervals, subtract_intervals
from turnwise.operators.relational import as_of


def test_word_errors():
    assert word_errors("a b c".split(), "a x c d".split()) == (1, 0, 1)
    assert word_errors([], ["a"]) == (0, 0, 1)
    assert word_errors(["a"], []) == (0, 1, 0)


def test_sequence_ratio():
    assert sequence_ratio("abc", "abc") == 100
    assert sequence_ratio("abcd", "bcde") == 75


def test_spans_do_not_overlap():
    found = find_spans("mail a.b@c.org or +1 (555) 123-4567, card 4111 2222 3333 4444, ssn 442-89-1099")
    assert [x[2] for x in found] == ["EMAIL", "PHONE", "CARD", "SSN"]


def test_masks(spark):
    docs = spark.createDataFrame([(1, "x@y.org and 442-89-1099", 0), (2, "again x@y.org.", 0), (3, "clean", 1)], "doc_id bigint, text string, call int")
    found = spans(docs, "doc_id")
    by_place = {r[0]: r[1] for r in mask_by_position(docs, found, "doc_id").collect()}
    assert by_place == {1: "[REDACTED] and [REDACTED]", 2: "again [REDACTED].", 3: "clean"}


def test_a_call_is_masked_alike_and_whole_if_other_text_was_searched(spark):
    texts = spark.createDataFrame([("a", 0, "Ann has 4821", 1), ("a", 1, "ann: 48215, Annex", 1), ("a", 2, None, 1), ("b", 0, "Ann", 2), ("c", 0, "clean", 1), ("d", 0, "never searched", 1), ("e", 0, "half searched", 1)], "call string, turn int, text string, revision int")
    found = spark.createDataFrame([("a", "Ann", 1), ("a", "4821", 1), ("b", "Ann", 1), ("c", None, 1), ("e", "half", 1), ("e", "half", 2)], "call string, value string, revision int")
    got = {(r.call, r.turn): r.masked for r in consistent_mask(texts, found, ["call", "turn"], "call").collect()}
    assert got == {("a", 0): "[REDACTED] has [REDACTED]", ("a", 1): "[REDACTED]: [REDACTED]5, Annex", ("a", 2): None, ("b", 0): "[REDACTED]", ("c", 0): "clean", ("d", 0): "[REDACTED]", ("e", 0): "[REDACTED]"}


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 2, 3), (1, 5, 9), (1, 6, 7)], "k int, s int, e int")
    assert sorted(map(tuple, merge_intervals(df, ["k"], "s", "e").select("s", "e").collect())) == [(0, 3), (5, 9)]
    cut = spark.createDataFrame([(1, 1, 6)], "k int, s int, e int")
    assert sorted(map(tuple, subtract_intervals(df, cut, ["k"], "s", "e").select("s", "e").collect())) == [(0, 1), (6, 9)]


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, at int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b")], "k int, at int, v string")
    assert sorted(map(tuple, as_of(left, right, "k", "at", ["v"]).collect()), key=str) == [(1, 1, None), (1, 5, "b"), (2, 9, None)]


def test_closure(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "job int, upstream int")
    assert {(r[0], r[1]): r[2] for r in closure(edges).collect()} == {(2, 1): 1, (3, 2): 1, (4, 3): 1, (3, 1): 2, (4, 2): 2, (4, 1): 3}


def test_any_date(spark):
    df = spark.createDataFrame([("2024-02-03",), ("2/3/2024",), ("2/3",), ("soon",), (None,)], "t string")
    assert [r[0] for r in df.select(any_date(F.col("t"))).collect()] == ["2024-02-03", "2024-02-03", "--02-03", None, None]


def test_entry_point_lists_everything(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
