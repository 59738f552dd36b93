"""Divergence of sources against plain Python, over many small stripes and blocks."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm import cases
from turnwise.llm import divergence as dv


def expected(rows: list[tuple], least: int, limit: int) -> list[tuple]:
    """Rows of (text, lang, source)."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs.keys() | {g[0] for g in counts}:
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        v = len(kept)
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * v) for t in kept}  # noqa: B023, E731
        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        for s, c in groups.items():
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, limit)):
                out += [(lang, s, part, item, f, i) for i, (f, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1)]
    return sorted(out)


def made(n_sources: int) -> list[tuple]:
    rng = random.Random(n_sources)
    words = ["".join(rng.choice("abcdéß日") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows = [(" ".join(rng.choice(words[: 20 + 7 * s % 40]) for _ in range(rng.randint(0, 60))) + " A1b--C_d", lang, f"s{s}") for lang, k in (("x", n_sources), ("y", 2), ("z", 1)) for s in range(k) for _ in range(4)]
    return [*rows, (None, None, None), ("only once", "w", "a"), ("", "w", "b"), ("ab " * 20_000, "x", "s0"), rows[0]]


@pytest.mark.parametrize(("n_sources", "stripe", "block", "seats"), [(1, 5, 2, 8), (6, 5, 2, 8), (7, 1000, 1, 8), (9, 3, 4, 2), (5, 7, 64, 1)])
def test_against_plain_python(spark, n_sources, stripe, block, seats):
    rows = made(n_sources)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    got = dv.source_divergence(df, 3, 5, stripe=stripe, block=block, seats=seats).collect()
    assert sorted(map(tuple, got)) == expected(rows, 3, 5)


def test_empty_table_and_clashing_columns(spark):
    assert dv.source_divergence(cases.empty(spark)).count() == 0
    rows = [(r[1], r[2], r[3]) for r in cases.rows()]
    assert sorted(map(tuple, dv.source_divergence(cases.frame(spark).selectExpr("*", "1 AS term", "2 AS stripe", "3 AS mass", "4 AS block"), 2).collect())) == expected(rows, 2, 50)


def test_counts_are_sent_on_before_they_fill_memory(spark, monkeypatch):
    rows = made(4)
    monkeypatch.setattr(dv, "HELD", 3)
    got = dv.source_divergence(spark.createDataFrame(rows, "text string, lang string, source string"), 3, 5).collect()
    assert sorted(map(tuple, got)) == expected(rows, 3, 5)


def test_shares_are_exact_beyond_64_bits():
    counts, mass = np.array([0, 1, 7, 10**14, 10**15], np.int64), 2 * 10**15 + 11
    assert dv.shares(counts, mass).tolist() == [1 + 10**9 * (int(c) + 5) // mass for c in counts]


def test_vectors_and_tournaments():
    ids, counts = np.array([0, 3, 4, 900]), np.array([1, 2, 10**12, 4])
    assert [x.tolist() for x in dv.unpack_vector(dv.pack_vector(ids, counts))] == [ids.tolist(), counts.tolist()]
    assert [x.tolist() for x in dv.unpack_vector(dv.pack_vector(ids[:0], counts[:0]))] == [[], []]


def test_every_pair_of_blocks_meets_once(spark):
    from pyspark.sql import functions as F

    for n in (2, 3, 4, 7, 8):
        turns = n + n % 2 - 1
        df = spark.range(n).select(F.col("id").cast("int").alias("b"))
        met = Counter()
        for t in range(turns):
            rows = df.select("b", dv.partner(F.col("b"), F.lit(n), t).alias("o")).collect()
            assert all(next(r.o for r in rows if r.b == x.o) == x.b for x in rows if x.o < n)
            met.update(frozenset((r.b, r.o)) for r in rows if r.o < n)
        assert len(met) == n * (n - 1) // 2 and set(met.values()) == {2}
