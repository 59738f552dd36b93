"""Byte-level BPE through a sentencepiece model serialised from the rank file.

The vocabulary's byte strings are mapped to printable characters, one for each byte, and
become the pieces of a BPE model, each scored by its negative rank, with an identity
normaliser. The model merges the best-scored neighbours, leftmost first, which is the rank
order of byte-level BPE. Texts are cut into pre-tokens by the pattern; a pre-token that is in
the vocabulary is its id, any other is encoded by the model, once for a task; decoding maps
ids back to byte strings.

Defined results: null counts as empty and has no ids. Repeated rows are returned each. An
empty table gives an empty result. Only id and text are used, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnwise.llm.pretokens import PieceCache
from turnwise.llm.text import text_slices, whole_text


def read_ranks(content: bytes) -> list[bytes]:
    """The byte string of each rank, from lines of base64 and rank."""
    pairs = [line.split() for line in content.splitlines() if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def byte_characters() -> dict[int, str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the others follow U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: int as varint, float as 32 bits, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """The model as protobuf; ids are ranks, and the unknown piece that the library needs comes after them."""
    chars = byte_characters()
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _field(2, float(score)) + _field(3, kind))
    pieces = [piece("".join(chars[b] for b in t), -rank, 1) for rank, t in enumerate(tokens)]
    pieces.append(piece("<unk>", 0, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    """Encodes texts to ids as little-endian 32-bit bytes and decodes ids to bytes."""

    def __init__(self, tokens: list[bytes], pattern: str, model: bytes | None = None) -> None:
        import sentencepiece

        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model or serialise_model(tokens))
        self.chars = {b: c for b, c in byte_characters().items()}
        self.cache = PieceCache(self._encode_pieces, pattern)

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        out = [self.ranks.get(r) for r in raw]
        todo = [i for i, rank in enumerate(out) if rank is None]
        ids = self.model.encode([raw[i].decode("latin-1").translate(self.chars) for i in todo], num_threads=1)
        packed = [x if x is None else struct.pack("<I", x) for x in out]
        for i, x in zip(todo, ids, strict=True):
            packed[i] = struct.pack(f"<{len(x)}I", *x)
        return packed

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(v) for v in self.cache.values(texts)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (binary, little-endian unsigned 32-bit) and decoded (binary) of every row."""
    return _run(docs, ranks_path, pattern, id_col, text_col, False)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every row: digests of what encode_documents returns."""
    return _run(docs, ranks_path, pattern, id_col, text_col, True)


def _run(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    with open(ranks_path, "rb") as f:
        tokens = read_ranks(f.read())
    shipped = docs.sparkSession.sparkContext.broadcast((tokens, serialise_model(tokens)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(shipped.value[0], pattern, shipped.value[1])
        for batch in text_slices(batches, "text", 2 << 20, 512):
            ids = bpe.encode(batch.column("text").to_pylist())
            decoded = map(bpe.decode, ids)
            if digests:
                columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary()), pa.array(list(decoded), pa.binary())], ["id", "ids", "decoded"])

    out = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded binary"
    return rows.mapInArrow(run, f"id {kind}, {out}").withColumnRenamed("id", id_col)
