"""Token counts and byte-level BPE against the libraries; media columns round trip."""

from __future__ import annotations

import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from llm import cases
from turnwise.llm import byte_bpe, mpeg_audio, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [r[1] or "" for r in cases.rows()] + ["a<|endoftext|>b", "  two  spaces \n\n", "\u00a0\u2003x", "'s 'LL don't", "x" * 5000]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_as_the_library_and_back(library):
    bpe = byte_bpe.ByteBPE(byte_bpe.read_ranks(open(RANKS, "rb").read()), public_tokenizers.PATTERN)
    for text, ids in zip(TEXTS, bpe.encode(TEXTS), strict=True):
        want = library.encode_ordinary(text)
        assert ids == struct.pack(f"<{len(want)}I", *want)
        assert bpe.decode(ids) == text.encode()


def test_round_trip(spark, library):
    rows = byte_bpe.round_trip(cases.frame(spark), RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for r in cases.rows():
        ids = library.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert byte_bpe.round_trip(cases.empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_counts_as_the_library(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [*[(r[0], r[1]) for r in cases.rows()], (100, "a<|endoftext|>b<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted([(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows], key=str)
    for _ in range(2):  # the second time every count comes from the cache
        got = token_counts.count_tokens(df, path, public_tokenizers.PATTERN, f"file://{tmp_path}/cache")
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert token_counts.count_tokens(cases.empty(spark), path, public_tokenizers.PATTERN).count() == 0


def test_cache_takes_new_texts_only(spark, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    token_counts.count_tokens(frame(["a b", "c d"]), path, public_tokenizers.PATTERN, cache).collect()
    token_counts.count_tokens(frame(["c d", "e f"]), path, public_tokenizers.PATTERN, cache).collect()
    stored = spark.read.parquet(f"{cache}/*")
    assert stored.count() == stored.select("digest").distinct().count() == 3


def test_media_round_trip(spark):
    for payload in [*(random.Random(n).randbytes(n) for n in (0, 1, 63, 64, 65, 900, 935, 936, 937, 50_000)), *((b"TAG" * 999)[i : i + 960] for i in range(3))]:
        media = mpeg_audio.store(mpeg_audio.pad(payload))
        stream = mpeg_audio.parse(media)
        assert mpeg_audio.payload_of(media, stream) == mpeg_audio.pad(payload)
        assert stream.bad_checksums == stream.junk_bytes == 0
        assert stream.table["frames"] == len(stream.offsets)


def test_media_resynchronises():
    media = mpeg_audio.store(mpeg_audio.pad(bytes(5000)))
    whole = mpeg_audio.parse(media)
    at = whole.offsets[2]
    junk = mpeg_audio.parse(media[:at] + b"\xff\xfbjunk" + media[at:])
    assert len(junk.offsets) == len(whole.offsets) and junk.junk_bytes == 6
    broken = bytearray(media)
    broken[whole.offsets[1] + 8] ^= 1
    assert mpeg_audio.parse(bytes(broken)).bad_checksums == 1


def test_media_digests(spark):
    got = {(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) for r in mpeg_audio.media_digests(cases.frame(spark)).collect()}
    want = {(r[0], len(t := (r[1] or "").encode()), len(p := mpeg_audio.pad(t)), hashlib.sha256(p).hexdigest()) for r in cases.rows()}
    assert got == want
    assert mpeg_audio.media_digests(cases.empty(spark)).count() == 0


def test_a_warm_cache_packs_no_text(spark, tmp_path, monkeypatch):
    import public_tokenizers

    docs = cases.frame(spark)
    ask = lambda: sorted(map(tuple, token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, cache_path=f"file://{tmp_path}").collect()), key=str)
    cold = ask()
    packed = []
    distinct = token_counts._distinct_texts
    monkeypatch.setattr(token_counts, "_distinct_texts", lambda rows: packed.append(rows.count()) or distinct(rows))
    assert ask() == cold and packed == [0]
    docs = docs.unionByName(docs.where("doc_id = 3").selectExpr("* EXCEPT (text)", "'quite new' AS text").select(docs.columns))
    assert len(ask()) == len(cold) + 1 and packed == [0, 1]
