"""Document fingerprints by content-defined chunking.

A gear hash of the last 16 bytes runs over a text; a chunk ends where its top bits are zero.
Chunk sizes are normalised: up to `NORMAL` bytes six bits must be zero, beyond it four, none
before `LEAST` and an end at `MOST` at the latest. As an end depends only on the bytes just
before it, an insertion shifts ends but does not move them against the text, and chunks
beyond the change are the same again. A fingerprint is the set of chunk digests with
their lengths (56 and 8 bits); the containment of one text in another is the share of its
chunks' bytes that the other has as well.

The neighbour of a document is the next one by descending id. Ids alone are dealt into ranges
first, to learn each range's first row; texts then travel once, compressed, to the range of
their id, and the first of each range also to the range before it. A task streams through its
sorted rows with the next one at hand.

Defined results: null counts as empty and has an empty fingerprint. A text with an empty
fingerprint is contained in another empty one with 1, in any other with 0; nothing but an
empty text is contained in an empty one. Rows with one id follow each other by a hash of
their texts, null ids come last, and repeated rows are each other's neighbours. A single row
is its own neighbour. Very long texts are cut whole. An empty table gives an empty result. Only
id and text are used, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from turnwise.llm.shingles import _constants, _mix, _powers
from turnwise.llm.text import text_slices, whole_text

#: Bytes of a chunk: none shorter but a text's last, a stricter rule up to NORMAL, none longer than MOST.
LEAST, NORMAL, MOST = 16, 48, 192
#: Top bits of the hash that are zero at an end, up to NORMAL bytes and beyond.
STRICT_BITS, LOOSE_BITS = 6, 4
#: Bytes of text that are hashed at once.
SLICE = 1 << 20

_GEAR = (_constants(256, 11) >> np.uint64(48)).astype(np.uint16)
_BYTE = _constants(256, 12)


def gear(data: np.ndarray) -> np.ndarray:
    """h = 2 h + G[byte] at each byte, in 16 bits, so that 16 bytes count; by doubling the window."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint16(k)
    return h


def _ends(strict: list[int], loose: list[int], at: int, end: int) -> list[int]:
    """The ends of the chunks of the bytes from at to end, by the places whose hash allows one."""
    out = []
    i, j = bisect_left(strict, at), bisect_left(loose, at)
    while end - at > LEAST:
        i = bisect_left(strict, at + LEAST - 1, i)
        if i < len(strict) and strict[i] < at + NORMAL - 1:
            cut = strict[i] + 1
        else:
            j = bisect_left(loose, at + NORMAL - 1, j)
            cut = min(loose[j] + 1 if j < len(loose) else end, at + MOST)
        at = min(cut, end)
        out.append(at)
    if at < end:
        out.append(end)
    return out


def chunk_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The fingerprint of each text as sorted distinct numbers: a digest's 56 bits, then 8 of its chunk's length."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return [np.empty(0, np.uint64)] * len(texts)
    h = gear(data)
    strict = np.flatnonzero(h < 1 << (16 - STRICT_BITS)).tolist()
    loose = np.flatnonzero(h < 1 << (16 - LOOSE_BITS)).tolist()
    ends: list[int] = []
    counts, at = [], 0
    for t in texts:
        # The first LEAST bytes of a chunk cannot end it, so no hash reaches into the text before.
        own = _ends(strict, loose, at, at + len(t))
        ends += own
        counts.append(len(own))
        at += len(t)
    stops = np.array(ends, np.int64)
    starts = np.append(0, stops[:-1])
    lengths = stops - starts
    inside = np.arange(len(data)) - np.repeat(starts, lengths)
    sums = np.add.reduceat(_BYTE[data] * _powers(MOST)[inside], starts)
    prints = (_mix(sums) & ~np.uint64(255)) | lengths.astype(np.uint64)
    return [np.unique(x) for x in np.split(prints, np.cumsum(counts)[:-1])]


def to_string(prints: np.ndarray) -> str:
    return base64.b64encode(prints.astype("<u8").tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def containment(own: np.ndarray, other: np.ndarray) -> float:
    """The share of the bytes in own's chunks that other has as well."""
    if not len(own):
        return float(not len(other))
    weight = (own & np.uint64(255)).astype(np.int64)
    return int(weight[np.isin(own, other, assume_unique=True)].sum()) / int(weight.sum())


def _containments(own: list[np.ndarray], other: list[np.ndarray]) -> list[float]:
    """`containment` of each pair, all at once: a pair's number is mixed into its prints."""
    place = lambda sets: np.repeat(_constants(len(sets), 13), [len(x) for x in sets])
    mine, theirs = np.concatenate(own), np.concatenate(other)
    hit = np.isin(mine ^ place(own), theirs ^ place(other))
    weight = (mine & np.uint64(255)).astype(np.int64)
    owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
    whole = np.bincount(owner, weight, len(own))
    shared = np.bincount(owner[hit], weight[hit], len(own))
    return [float(shared[i] / whole[i]) if len(own[i]) else float(not len(other[i])) for i in range(len(own))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint of every row; no shuffle."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), whole_text(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            found = chunk_sets(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(to_string, found), pa.string())], ["id", "fingerprint"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def _order(id_value, tie: int) -> tuple:
    """Rises as the ids fall, null last; ids themselves may be text, which has no negative."""
    return (id_value is not None, id_value if id_value is not None else 0, tie)


def _heads(keys: DataFrame, ranges: int) -> list[tuple]:
    """The key of the first row of each range, ascending in `_order`: one for a range, however many rows there are."""
    dealt = keys.repartitionByRange(ranges, F.desc_nulls_last("id"), F.desc("tie")).withColumn("range", F.spark_partition_id())
    order = F.struct(F.col("id").isNotNull().alias("a"), F.col("id").alias("b"), F.col("tie").alias("c"))
    return sorted({_order(*r) for r in dealt.groupBy("range").agg(F.max(order).alias("o")).select("o.b", "o.c").collect()})


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(range, ahead, id, tie, packed): every row in the range of its id, and with `ahead` = 1 the first row of the next range. packed: the text, compressed."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), whole_text(f"`{text_col}`").alias("text")).select("id", "text", F.xxhash64("text").alias("tie"))
    heads = _heads(rows.select("id", "tie"), ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shipped = spark.sparkContext.broadcast(heads)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, n = shipped.value, len(shipped.value)
        pack = zstandard.ZstdCompressor(level=3)
        for batch in text_slices(batches, "text"):
            ids, ties = batch.column("id").to_pylist(), batch.column("tie").to_pylist()
            take, to, ahead = [], [], []
            for i, key in enumerate(map(_order, ids, ties)):
                k = bisect_left(tops, key)  # a range holds the keys from below its head down to the next one
                take.append(i)
                to.append(n - 1 - k)
                ahead.append(0)
                if tops[k] == key:
                    take.append(i)
                    to.append((n - 2 - k) % n)
                    ahead.append(1)
            packed = [pack.compress(t.as_buffer()) for t in batch.column("text")]
            picked = pa.array(take, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(ahead, pa.int32()), batch.column("id").take(picked), batch.column("tie").take(picked), pa.array([packed[i] for i in take], pa.binary())], ["range", "ahead", "id", "tie", "packed"])

    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.mapInArrow(deal, f"range int, ahead int, id {kind}, tie bigint, packed binary")
    return dealt.repartition("range").sortWithinPartitions("range", "ahead", F.desc_nulls_last("id"), F.desc("tie"))


def _results(ids: list, texts: list[str], after: list[str], kind: pa.DataType) -> pa.RecordBatch:
    edited = []
    for own, following in zip(texts, after, strict=True):
        k = len(own) // 2
        edited.append((own[: len(own) - k] + following[:k]).encode())
    sets = chunk_sets([t.encode() for t in [*texts, after[-1]]] + edited)
    n = len(texts)
    own, follower, changed = sets[:n], sets[1 : n + 1], sets[n + 1 :]
    columns = [pa.array(ids, kind), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited])]
    columns += [pa.array(map(to_string, own)), pa.array(map(to_string, changed)), pa.array(_containments(own, changed)), pa.array(_containments(own, follower))]
    return pa.RecordBatch.from_arrays(columns, ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has the row's second half (rounded down) replaced by as much of its
    neighbour's beginning; near_*: containment of the row in the edited text and in the neighbour.
    """
    dealt = neighbours(docs, id_col, text_col, ranges)
    kind = dealt.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        ids, texts, held, last = [], [], 0, None  # rows of one range, the last one still without its neighbour
        for batch in text_slices(batches, "packed", SLICE // 4):
            of_id = batch.column("id")
            for i, (r, ahead, packed) in enumerate(zip(batch.column("range").to_pylist(), batch.column("ahead").to_pylist(), batch.column("packed").to_pylist(), strict=True)):
                if ahead and r != last:
                    continue  # another copy of the next range's head
                text = unpack.decompress(packed).decode()
                if texts and (ahead or held > SLICE):
                    yield _results(ids, texts, [*texts[1:], text], of_id.type)
                    ids, texts, held = [], [], 0
                if ahead:
                    last = None
                else:
                    last = r
                    ids.append(of_id[i].as_py())
                    texts.append(text)
                    held += len(text)

    out = f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, out).withColumnRenamed("id", id_col)
