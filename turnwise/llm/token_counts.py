"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content, and a tokenizer's the SHA-256 of its
file, its library's version and the options used. Stored counts lie in a Parquet table with a
folder for each tokenizer key. Keys are joined to it first. Of the texts, a bitmap of fixed
size passes those of missing keys; each task drops its own repeats and compresses the rest,
which then travel, meet the missing keys exactly and are encoded; their counts are appended to
the table, from which the result is then joined.

Normalisation here is only null to empty: a count depends on every byte. Two writers may
append the same key; both wrote the same count, and the reader takes one.

For byte-level BPE without a normaliser the library's own pattern cuts texts into pieces that
it merges one by one, so a text's count is the sum over its pieces, and each distinct piece
is given to the library once for a task. Other tokenizers get whole texts.

Defined results: null and empty texts have 0 bytes and 0 tokens. Repeated rows are returned
each. An empty table gives an empty result. Only id and text are used, so other columns
cannot clash. Texts are never truncated.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from importlib.metadata import version

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from turnwise.llm.bitmaps import bitmap, with_hit
from turnwise.llm.pretokens import PieceCache
from turnwise.llm.text import text_slices, whole_text
from turnwise.session import materialise, shared_dir


#: Digests that a task remembers to drop repeats.
SEEN = 200_000


def tokenizer_key(content: bytes, kind: str) -> str:
    library = {"json": "tokenizers", "model": "sentencepiece"}[kind]
    return hashlib.sha256(b"\0".join([content, library.encode(), version(library).encode(), b"no added tokens"])).hexdigest()


def counter(content: bytes, kind: str, pattern: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their token counts."""
    if kind == "model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def whole(texts: list[str]) -> list[int]:
        return [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    spec = json.loads(content)
    pre = spec.get("pre_tokenizer") or {}
    by_pieces = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec["model"].get("dropout") is None
    added = [x["content"] for x in spec.get("added_tokens", ())]
    if not by_pieces or any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", ())):
        return whole
    cache = PieceCache(whole, pattern)
    cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def count(texts: list[str]) -> list[int]:
        # The library takes the strings of added tokens out first; each is one token.
        extra = [len(cut.findall(t)) if cut else 0 for t in texts]
        plain = [t for t, n in zip(texts, extra, strict=True) if not n]
        sums = iter([sum(v) for v in cache.values(plain)])
        out = []
        for t, n in zip(texts, extra, strict=True):
            out.append(n + sum(map(sum, cache.values(cut.split(t)))) if n else next(sums))
        return out

    return count


def _distinct_texts(rows: DataFrame) -> DataFrame:
    """(digest, packed): the first row of each digest in a task, its text compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        pack = zstandard.ZstdCompressor(level=1)
        for batch in text_slices(batches, "text"):
            digests, packed = [], []
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text"), strict=True):
                if digest not in seen:
                    # Bounded: a repeat that slips through is dropped where the digests are sorted.
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(digest)
                    digests.append(digest)
                    packed.append(pack.compress(text.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(packed, pa.binary())], ["digest", "packed"])

    return rows.mapInArrow(run, "digest string, packed binary")


def _encode(texts: DataFrame, content: bytes, kind: str, pattern: str) -> DataFrame:
    """(digest, n_tokens) of rows that lie sorted by digest in each partition."""
    shipped = texts.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = counter(shipped.value, kind, pattern), None
        unpack = zstandard.ZstdDecompressor()
        for batch in text_slices(batches, "packed", 1 << 20, 512):
            digests, found = [], []
            for digest, packed in zip(batch.column("digest").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if digest != last:
                    last = digest
                    digests.append(digest)
                    found.append(unpack.decompress(packed).decode())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(count(found), pa.int64())], ["digest", "n_tokens"])

    return texts.mapInArrow(run, "digest string, n_tokens bigint")


def stored_counts(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("digest string, n_tokens bigint").parquet(path)
    except AnalysisException:
        return None


def count_tokens(docs: DataFrame, tokenizer_path: str, pattern: str, cache_path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row. cache_path: folder of stored counts; None: a new one in the shared folder."""
    spark = docs.sparkSession
    kind = tokenizer_path.rpartition(".")[2]
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    path = f"{cache_path or f'{shared_dir(spark)}/turnwise/token-counts-{uuid.uuid4().hex}'}/{tokenizer_key(content, kind)}"
    text = whole_text(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.sha2(text, 256).alias("digest"))
    keyed = materialise(rows.select("id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")), "token-keys")
    stored = stored_counts(spark, path)
    texts = rows.select("digest", "text")
    if stored is None:
        packed = _distinct_texts(texts).repartition("digest")
    else:
        missing = materialise(keyed.select("digest").distinct().join(stored.select("digest"), "digest", "left_anti"), "token-missing")
        wanted = with_hit(texts, F.xxhash64("digest"), bitmap(missing, F.xxhash64("digest"))).where("hit").select("digest", "text")
        packed = _distinct_texts(wanted).join(missing, "digest", "left_semi").repartition("digest")
    _encode(packed.sortWithinPartitions("digest"), content, kind, pattern).write.mode("append").parquet(path)
    counts = stored_counts(spark, path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.join(counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
