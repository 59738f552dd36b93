"""Alignment of tokenizers against whole texts and dictionaries."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm import cases
from turnwise.llm import alignment
from turnwise.llm.byte_bpe import byte_characters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(texts: list[str]) -> list[tuple[list, list]]:
    """((id, begin, end) of A and B) of each text, by the libraries over whole texts."""
    ta = Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {c: b for b, c in byte_characters().items()}
    out = []
    for t in texts:
        sides = [[(i, bytes(back[c] for c in ta.id_to_token(i))) for i in ta.encode(" " + t, add_special_tokens=False).ids]]
        sides.append([(i, bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()) for i in tb.encode(t)])
        if not t or any(b"".join(x for _, x in s) != (" " + t).encode() for s in sides):
            out.append(([], []))
            continue
        spans = []
        for s in sides:
            at, own = 0, []
            for i, x in s:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        out.append(tuple(spans))
    return out


def expected(texts: list[str]) -> list[tuple]:
    sides = tokens(texts)
    links = [[(i, j) for i, a0, a1 in a for j, b0, b1 in b if a0 < b1 and b0 < a1] if len(a) < 3000 else swept(a, b) for a, b in sides]
    count = Counter(x for own in links for x in own)
    best: dict[int, int] = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for (a, b), own in zip(sides, links):
        both = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, last = [], 0
        for e in both:
            groups.append("|".join(",".join(str(i) for i, s, _ in side if last <= s < e) for side in (a, b)) if len(a) < 3000 else None)
            last = e
        digest = "" if not a else hashlib.sha256(";".join(groups).encode()).hexdigest() if None not in groups else None
        out.append((len(a), len(b), len(both), len(own), sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), digest))
    return out


def swept(a: list, b: list) -> list:
    out, k = [], 0
    for i, a0, a1 in a:
        while b[k][2] <= a0:
            k += 1
        m = k
        while m < len(b) and b[m][1] < a1:
            out.append((i, b[m][0]))
            m += 1
    return out


TEXTS = ["a  b", " x ", "abc ", "  ", "\n \n x", "tab\tnew\nline", "x  y z  ", "<|endoftext|> and <s> <0x41> <unk>", "▁a", "a▁b c", "don't we'll 12345 6,789.0!!! ¿qué? 日本語 かな", "é́ ​ zwj 👩‍👩‍👧 \x00 \x7f nul", "x" * 3000, " ".join(["word"] * 500), "end\r\n\r\n  indented  code\n\tx = 1\n", "﻿bom", "½ ² ﬁ ", "a 　 b", "  x  "]


def test_pieces_cut_only_where_neither_tokenizer_merges():
    a, b = (open(p, "rb").read() for p in (A, B))
    aligner = alignment.Aligner(alignment.ByteLevelA(a), alignment.PiecesB(b))
    assert aligner.cuts
    texts = TEXTS + [r[1] for r in cases.rows() if r[1]]
    for t in texts:
        cut = alignment.pieces(" " + t)
        assert "".join(cut) == " " + t
        assert sum(aligner.a.encode(cut), []) == aligner.a.encode([" " + t])[0]
        assert sum(aligner.b.encode(cut), []) == aligner.b.encode([" " + t])[0]


@pytest.mark.parametrize(("matrix_bytes", "cell_bytes", "held"), [(alignment.MATRIX_BYTES, alignment.CELL_BYTES, alignment.PAIRS), (8 * 50257 * 1000, 200, 50)])
def test_against_dictionaries(spark, monkeypatch, matrix_bytes, cell_bytes, held):
    monkeypatch.setattr(alignment, "PAIRS", held)
    monkeypatch.setattr(alignment, "PAGE_ROWS", 7)
    rows = cases.rows() + [(100 + i, t, *cases.rows()[0][2:]) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    got = alignment.align_tokens(df, A, B, matrix_bytes=matrix_bytes, cell_bytes=cell_bytes).collect()
    want = expected([r[1] or "" for r in rows])
    key = lambda x: (x[0] is not None, x[0] or 0)
    got = sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got), key=key)
    for g, w in zip(got, sorted(((r[0], *w) for r, w in zip(rows, want)), key=key), strict=True):
        assert g[:7] == w[:7]
        assert w[7] is None or g[7] == w[7]


def test_empty_table_and_text_ids(spark):
    assert alignment.align_tokens(cases.empty(spark), A, B).count() == 0
    got = alignment.align_tokens(spark.createDataFrame([("k", None), ("l", "one")], "doc_id string, text string"), A, B).collect()
    assert sorted(tuple(r)[:5] for r in got) == [("k", 0, 0, 0, 0), ("l", 1, 1, 1, 1)]
