"""The Jaccard join and exact dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from llm import cases
from turnwise.llm import components, exact_dedup, jaccard_join, shingles
from turnwise.session import materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows: list[tuple]) -> list[tuple]:
    """(id, size of set, smallest id of the group) of every row."""
    sets = [shingle_set(r[1]) for r in rows]
    group = list(range(len(rows)))
    find = lambda x: x if group[x] == x else find(group[x])
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                group[find(i)] = find(j)
    least: dict = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    low = lambda ids: None if None in ids else min(ids)
    return sorted(((r[0], len(s), low(least[find(i)])) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)


def test_edge_cases(spark):
    assert got(jaccard_join.near_groups(cases.frame(spark))) == brute(cases.rows())


def test_empty(spark):
    assert jaccard_join.near_groups(cases.empty(spark)).count() == 0
    assert jaccard_join.near_dedup(cases.empty(spark)).count() == 0


def test_groups_without_a_centre(spark):
    """Chains, where each copy changes the one before, and stars whose original is not there."""
    rng = random.Random(9)
    rows, n = [], 0
    for _ in range(3):
        text = cases.words(rng, 100)
        for _ in range(25):
            text = list(text)
            text[rng.randrange(100)] = cases.words(rng, 1)[0]
            rows.append((n := n + 1, " ".join(text)))
    for _ in range(3):
        base = cases.words(rng, 100)
        for _ in range(25):
            text = list(base)
            for i in rng.sample(range(100), 2):
                text[i] = cases.words(rng, 1)[0]
            rows.append((n := n + 1, " ".join(text)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert got(jaccard_join.near_groups(df)) == brute(rows)


def brute_labels(sets: dict) -> dict:
    """Smallest name of each set's group."""
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


@pytest.mark.parametrize(("cell", "deep"), [(4, 5), (4, 1), (1024, 5)])
def test_regions_windows_and_tiles_lose_no_link(spark, cell, deep):
    """Families around templates, at distances from far below to far above the radius, joined with tiny regions."""
    rng = random.Random(cell + deep)
    sets = {}
    for _ in range(6):
        base = [rng.getrandbits(62) for _ in range(rng.choice((10, 50, 100)))]
        for _ in range(22):
            share = rng.choice((0.02, 0.1, 0.11, 0.12, 0.3, 0.5))
            own = [rng.getrandbits(62) if rng.random() < share else s for s in base]
            sets[len(sets)] = frozenset(own[: rng.randint(len(own) * 8 // 10, len(own))])
            if rng.random() < 0.5:
                base = own if rng.random() < 0.3 else base
    rows = [(i, len(s), np.array(sorted(s), np.uint64).tobytes()) for i, s in sets.items()]
    links = jaccard_join.links_of(spark.createDataFrame(rows, "rid bigint, n bigint, entries binary"), cell=cell, deep=deep).collect()
    label = {i: i for i in sets}
    for a, b in links:
        assert 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
        low, high = sorted((label[a], label[b]))
        label = {k: low if v == high else v for k, v in label.items()}
    assert label == brute_labels(sets)


def test_strangers_that_no_pivot_parts_are_joined_in_tiles(spark, monkeypatch):
    """A family of which hardly two members are linked: a window that keeps them all goes to tiles, not through one step after another."""
    rng = random.Random(11)
    base = [rng.getrandbits(62) for _ in range(60)]
    sets = {i: frozenset(rng.getrandbits(62) if rng.random() < 0.15 else s for s in base) for i in range(60)}
    steps = []
    monkeypatch.setattr(jaccard_join, "materialise", lambda df, tag, keep=False: (steps.append(tag), materialise(df, tag, keep))[1])
    rows = [(i, len(s), np.array(sorted(s), np.uint64).tobytes()) for i, s in sets.items()]
    links = jaccard_join.links_of(spark.createDataFrame(rows, "rid bigint, n bigint, entries binary"), cell=4, tiles=1).collect()
    label = {i: i for i in sets}
    for a, b in links:
        assert 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
        low, high = sorted((label[a], label[b]))
        label = {k: low if v == high else v for k, v in label.items()}
    assert label == brute_labels(sets)
    assert steps.count("join-measured") <= 2


@pytest.mark.parametrize(("k", "block"), [(5, 1 << 22), (40, 1 << 22), (40, 100)])
def test_counts_of_shared_entries(monkeypatch, k, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(k)
    sets = [np.array(sorted({rng.randrange(30) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randint(1, 40))}), np.uint64) for _ in range(k)]
    asking = np.array([3, 0, 4])
    counts = jaccard_join.shared_counts(asking, np.array([len(s) for s in sets]), np.concatenate(sets))
    assert counts.tolist() == [[len(np.intersect1d(sets[i], s)) for s in sets] for i in asking.tolist()]


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_text_ids_null_ids_and_repeated_rows(spark, kind):
    rng = random.Random(2)
    texts = [" ".join(cases.words(rng, 30)) for _ in range(3)]
    rows = [("a1" if kind == "string" else 1, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), ("b" if kind == "string" else 2, texts[2])]
    rows += [rows[4], rows[4]]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    assert got(jaccard_join.near_groups(df)) == brute(rows)
    assert jaccard_join.near_dedup(df).count() == 3


def test_near_dedup_keeps_columns_and_one_of_each_group(spark):
    kept = jaccard_join.near_dedup(cases.frame(spark))
    assert kept.columns == cases.frame(spark).columns
    want = {r[0] for r in brute(cases.rows()) if r[0] == r[2]}
    assert {r["doc_id"] for r in kept.collect()} == want


@pytest.mark.parametrize("width", [1, 5])
def test_shingle_counts(width):
    texts = ["a b c d e f", "A  B\tc d E f", "a b", "", "a a a a a a a", "é b c d e"]
    found = shingles.shingle_sets(pa.array(texts), width)
    want = [len({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}) if w else 0 for w in (t.lower().split() for t in texts)]
    assert list(map(len, found)) == want
    assert np.array_equal(found[0], found[1])


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (40, 60)], "a int, b int")
    labels = spark.createDataFrame([(i, i) for i in [*range(31), 40, 50, 60, 70]], "node int, label int")
    assert {r[0]: r[1] for r in components.connected(labels, edges).collect()} == {**{i: 0 for i in range(31)}, 40: 40, 50: 40, 60: 40, 70: 70}


@pytest.mark.parametrize("primes", [exact_dedup.PRIMES, (2, 3, 5, 7)])
def test_exact_dedup(spark, primes):
    """With small primes many fingerprints collide, and the comparison alone must tell texts apart."""
    rows = cases.rows()
    ids: dict = defaultdict(list)
    for r in rows:
        ids[r[1] or ""].append(r[0])
    best = lambda xs: max((x for x in xs if x is not None), default=None)
    want = sorted(((r[0], best(ids[r[1] or ""]), len(ids[r[1] or ""]), r[0] == best(ids[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows), key=str)
    assert got(exact_dedup.exact_dedup(cases.frame(spark), segment_bytes=4096, primes=primes, salt_rows=2)) == want


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(cases.empty(spark)).count() == 0


def test_fingerprints_compose():
    kernel = exact_dedup._kernel()
    a, b = b"some bytes" * 700, b"others" * 900
    whole, x, y = exact_dedup.fingerprints([a + b, a, b], kernel)
    assert exact_dedup.combine([(0, len(a), x), (1, len(b), y)]) == whole


def test_longer_prefix_keeps_every_linked_set(spark):
    """Pairs at the threshold's very border, of unequal sizes too; sets without a partner go."""
    rng = np.random.default_rng(5)
    rows, linked = [], set()
    for n in [*range(1, 60), 100, 250, 999]:
        for lost in {0, n // 10, n // 5}:
            # y lacks `lost` of x's shingles and has as many others as the threshold allows.
            extra = max(0, (n - lost) * 100 // 80 - n)
            values = rng.integers(0, 1 << 63, n + extra, dtype=np.uint64)
            for own in (values[:n], values[lost:]):
                rows.append((len(rows), len(own), np.sort(own).tobytes(), len(rows)))
            if (n - lost) * 100 >= (n + extra) * 80:
                linked |= {rows[-1][0], rows[-2][0]}
    alone = len(rows)
    rows += [(alone + i, 40, np.sort(rng.integers(0, 1 << 63, 40, dtype=np.uint64)).tobytes(), alone + i) for i in range(20)]
    sets = spark.createDataFrame(rows, "rid bigint, n bigint, entries binary, at bigint").coalesce(1)
    kept = {r.rid for r in jaccard_join._able(sets, (80, 100)).select("rid").collect()}
    assert linked <= kept
    assert not kept & set(range(alone, alone + 20))
