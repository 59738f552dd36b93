"""Quotes of every length, and quotes that begin or end inside a word, against plain Python."""

from __future__ import annotations

from turnwise.functions.text import evidence


def test_evidence_is_a_substring(spark):
    texts = ["", "alpha", "alpha beta", "alpha beta gamma", "alpha beta gamma delta epsilon zeta eta", "the alphabet and beta gamma deltas epsilons", None]
    quotes = ["", "alpha", "pha", "alpha beta", "ha be", "beta gamma", "ta gamma del", "pha beta gamma", "pha beta gamma delta", "beta gamma delta epsi", "pha beta gamma delta epsilon z", "gamma beta alpha", "zeta eta theta", None]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    q = spark.createDataFrame(list(enumerate(quotes)), "item_id int, text string")
    want = [(i, d) for i, x in enumerate(quotes) for d, y in enumerate(texts) if x and y and x in y]
    assert sorted(map(tuple, evidence(t, q, "doc_id", "item_id").collect())) == want
    assert evidence(t, q.where("false"), "doc_id", "item_id").count() == 0
