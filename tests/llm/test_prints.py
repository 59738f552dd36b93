"""Fingerprints by content-defined chunking against a byte-by-byte version."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from llm import cases
from turnwise.llm import chunk_prints as cp


def cut_slowly(data: bytes) -> list[bytes]:
    """The chunks of one text, with the hash rolled from the start of each."""
    out, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = (2 * h + int(cp._GEAR[b])) % 65536
        n = i + 1 - start
        bits = cp.STRICT_BITS if n < cp.NORMAL else cp.LOOSE_BITS
        if n == cp.MOST or (n >= cp.LEAST and h < 1 << (16 - bits) and i + 1 < len(data)):
            out.append(data[start : i + 1])
            start, h = i + 1, 0
    return out + ([data[start:]] if start < len(data) else [])


def weights(text: str) -> dict[bytes, int]:
    return {c: len(c) for c in cut_slowly(text.encode())}


def share(a: str, b: str) -> float:
    own, other = weights(a), weights(b)
    return sum(n for c, n in own.items() if c in other) / sum(own.values()) if own else float(not other)


def expected(rows: list[tuple]) -> list[tuple]:
    out = []
    for (i, t), (_, follower) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 2
        edited = t[: len(t) - k] + follower[:k]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), share(t, edited), share(t, follower)))
    return out


def plain(r) -> tuple:
    return r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_against_slow_version(spark, ranges):
    rows = [(r[0], r[1] or "") for r in cases.rows() if r[0] is not None and r[0] != 7]  # id 7 occurs twice
    df = cases.frame(spark).where("doc_id <> 7")
    got = cp.compare_with_edits(df, ranges=ranges).collect()
    want = expected(sorted(rows, reverse=True))
    for g, w in zip(sorted(map(plain, got), reverse=True), want, strict=True):
        assert g[:3] == w[:3]
        assert g[3:] == pytest.approx(w[3:])
    by_text = {}
    for r in got:
        text = dict(rows)[r.doc_id]
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert len(cp.from_string(r.fingerprint)) == len(weights(text))
        assert r.near_edited == pytest.approx(cp.containment(cp.from_string(r.fingerprint), cp.from_string(r.edited_fingerprint)))
    prints = {r.doc_id: r.fingerprint for r in cp.fingerprints(df).collect()}
    assert prints == {r.doc_id: r.fingerprint for r in got}


def test_null_ids_repeats_and_single_rows(spark):
    got = cp.compare_with_edits(cases.frame(spark), ranges=4).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in cases.rows())
    assert len({r.fingerprint for r in got if r.doc_id == 7}) == 1
    assert any(r.near_next == 1 for r in got if r.doc_id == 7)  # a repeated row follows itself
    one = cp.compare_with_edits(spark.createDataFrame([("a", "x" * 50)], "doc_id string, text string")).first()
    assert (one.n_chars, one.near_next, one.near_edited) == (50, 1.0, 1.0)
    assert cp.compare_with_edits(cases.empty(spark)).count() == 0


def test_text_ids(spark):
    rows = [(f"id{i:03}", " ".join(f"w{i * k % 97}" for k in range(200))) for i in range(40)]
    got = cp.compare_with_edits(spark.createDataFrame(rows, "doc_id string, text string"), ranges=5).collect()
    assert sorted(r.edited_sha256 for r in got) == sorted(e[2] for e in expected(sorted(rows, reverse=True)))


def test_an_insertion_moves_chunks_without_changing_them():
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 20_000, np.uint8))
    own, shifted = cp.chunk_sets([text, text[:9_000] + b"inserted" + text[9_000:]])
    assert cp.containment(own, shifted) > 0.98
    half, other = cp.chunk_sets([text[:10_000], bytes(rng.integers(97, 123, 10_000, np.uint8))])
    assert cp.containment(half, own) > 0.98
    assert 0.48 < cp.containment(own, half) < 0.52
    assert cp.containment(own, other) == 0
