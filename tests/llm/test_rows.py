"""Tables with repeated ids and fully repeated rows: decisions hold for rows, not for ids."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from llm import cases
from turnwise.llm import exact_dedup, jaccard_join, mixing

SCHEMA = "doc_id bigint, text string, source string"


def table(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    rows = [(5, "a", "x"), (5, "b", "y"), (9, "a", "z"), (7, "c", "x"), (7, "c", "x"), (None, "a", "x"), (None, "d", "x"), (None, "d", "x")]
    want = Counter([(5, "b", "y"), (9, "a", "z"), (7, "c", "x"), (None, "d", "x")])
    assert Counter(map(tuple, corpus_pipeline.drop_copies(spark, table(spark, rows), "").collect())) == want
    for primes in (exact_dedup.PRIMES, (2, 3, 5, 7)):
        kept = exact_dedup.distinct_documents(table(spark, rows), primes=primes)
        assert kept.columns == ["doc_id", "text", "source"]
        assert Counter(map(tuple, kept.collect())) == want


def test_near_dedup_keeps_one_row_of_each_group(spark):
    rng = random.Random(3)
    one, two, other = (cases.words(rng, 80) for _ in range(3))
    near = [*one[:79], "changed"]
    rows = [(5, " ".join(one), "x"), (5, " ".join(two), "y"), (3, " ".join(near), "z"), (8, " ".join(other), "x"), (8, " ".join(other), "x"), (6, "", "x"), (6, "", "x")]
    want = Counter([rows[1], rows[2], rows[3], rows[5], rows[6]])
    assert Counter(map(tuple, jaccard_join.near_dedup(table(spark, rows)).collect())) == want


def test_mix_repeats_rows_by_their_own_share(spark):
    """Two ids name all rows of two sources, of which the mix takes one fully and the other in part."""
    rng = random.Random(4)
    rows = [(i % 2, " ".join(cases.words(rng, 300)), f"s{i % 3}") for i in range(60)]
    docs = table(spark, rows)
    got = Counter(r["text"] for r in mixing.repeat_documents(docs).collect())
    assert all(n <= 2 for n in got.values())
    taken = mixing.mix(docs).collect()
    assert abs(sum(got.values()) - sum(round(r["taken"] / r["size"]) for r in taken)) <= 2
