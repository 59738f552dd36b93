"""Exact deduplication by composable polynomial fingerprints and a chunkwise comparison.

A text's fingerprint is its UTF-8 bytes as a polynomial, evaluated at four bases modulo four
31-bit primes, with its length. Fingerprints compose: H(ab) = H(a) * r^len(b) + H(b). Texts
over `segment_bytes` are therefore cut into segments that are dealt over the cluster, hashed
in parallel and combined by length-shifted sums; the others are hashed where they are read.

Rows of one fingerprint are then compared with the group's representative (its largest id),
chunk by chunk. Of a large group, the representative's chunks are copied to as many salts as
the group needs, so that no task gets a whole group. Rows that differ from it form the next
round's groups, until none differs, so a collision costs a round and never a wrong merge.
What is decided on rows comes back to them by id and digest. A bitmap of fixed size tells
before the shuffle which rows that may concern, so texts travel only where a fingerprint
repeats.

Defined results: null counts as empty; all empty texts are one group. Of fully repeated rows
(same id, same text) each is returned, and all of them are kept or none, as the id decides.
Very long texts are cut into segments and chunks. An empty table gives an empty result. Any
type of id will do, and a null id is ordered below all others. Only id and text are used, so
other columns cannot clash. `distinct_documents` keeps one row of each group: of rows with
equal id and text that differ in other columns, any one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnwise.llm.bitmaps import bitmap, with_hit
from turnwise.llm.text import text_slices, whole_text
from turnwise.session import materialise, scratch

# The largest primes below 2^31 and four bases.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1812433253, 1664525, 69069)

SEGMENT_BYTES = 64 << 10
BLOCK = 2048
SALT_ROWS = 256


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * base % prime
    return out


def _kernel(primes: tuple[int, ...] = PRIMES, bases: tuple[int, ...] = BASES) -> np.ndarray:
    """BLOCK x k matrix; a block's bytes times it are exact in doubles, as 2048 * 255 * 2^31 < 2^53."""
    return np.stack([_powers(r, p, BLOCK)[::-1] for r, p in zip(bases, primes, strict=True)], axis=1).astype(np.float64)


def fingerprints(texts: list[bytes], kernel: np.ndarray, primes: tuple[int, ...] = PRIMES, bases: tuple[int, ...] = BASES) -> list[tuple[int, ...]]:
    """Of each byte string: leading zeros to whole blocks change nothing, then blocks combine by r^BLOCK."""
    counts = [max(1, -(-len(t) // BLOCK)) for t in texts]
    whole = np.frombuffer(b"".join(t.rjust(n * BLOCK, b"\0") for t, n in zip(texts, counts, strict=True)), np.uint8).reshape(-1, BLOCK)
    part = np.concatenate([whole[i : i + 2048].astype(np.float64) @ kernel for i in range(0, len(whole), 2048)]).astype(np.int64) % np.array(primes)
    shift = [pow(r, BLOCK, p) for r, p in zip(bases, primes, strict=True)]
    out, at = [], 0
    for n in counts:
        if n == 1:
            out.append(tuple(part[at].tolist()))
        else:
            h = [0] * len(primes)
            for row in part[at : at + n].tolist():
                h = [(x * s + y) % p for x, s, y, p in zip(h, shift, row, primes, strict=True)]
            out.append(tuple(h))
        at += n
    return out


def combine(parts: list[tuple[int, int, tuple[int, ...]]], primes: tuple[int, ...] = PRIMES, bases: tuple[int, ...] = BASES) -> tuple[int, ...]:
    """Fingerprint of a whole from (position, length, fingerprint) of its segments."""
    h = [0] * len(primes)
    for _, n, part in sorted(parts):
        h = [(x * pow(r, n, p) + y) % p for x, r, y, p in zip(h, bases, part, primes, strict=True)]
    return tuple(h)


def _hash_rows(df: DataFrame, keep: str, primes: tuple[int, ...], bases: tuple[int, ...]) -> DataFrame:
    """Adds h array<long> for the binary column `bytes` and drops that; `keep`: DDL of the other columns."""
    names = [x.split()[0] for x in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = _kernel(primes, bases)
        for batch in text_slices(batches, "bytes", 2 << 20):
            h = fingerprints(batch.column("bytes").to_pylist(), kernel, primes, bases)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(h, pa.list_(pa.int64()))], [*names, "h"])

    return df.mapInArrow(run, f"{keep}, h array<bigint>")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES, primes: tuple[int, ...] = PRIMES, bases: tuple[int, ...] = BASES) -> DataFrame:
    """(id, n_bytes, sha256, h) of every row."""
    text = whole_text(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.encode(text, "UTF-8").alias("bytes"), F.sha2(text, 256).alias("sha256")).withColumn("n_bytes", F.octet_length("bytes").cast("bigint"))
    id_type = rows.schema["id"].dataType.simpleString()
    short = _hash_rows(rows.where(F.col("n_bytes") <= segment_bytes), f"id {id_type}, n_bytes bigint, sha256 string", primes, bases)
    cut = F.sequence(F.lit(0), ((F.col("n_bytes") - 1) / segment_bytes).cast("int"))
    long = rows.where(F.col("n_bytes") > segment_bytes).withColumn("row", F.monotonically_increasing_id()).withColumn("seg", F.explode(cut))
    long = long.select("row", "id", "n_bytes", "sha256", "seg", F.substring(F.col("bytes"), F.col("seg") * segment_bytes + 1, F.lit(segment_bytes)).alias("bytes")).repartition("sha256", "seg")
    hashed = _hash_rows(long, f"row bigint, id {id_type}, n_bytes bigint, sha256 string, seg int", primes, bases)
    # H of the whole = sum over segments of H(segment) * r^(bytes after it): a commutative sum, so it combines map-side.
    after = F.greatest(F.col("n_bytes") - (F.col("seg") + 1) * segment_bytes, F.lit(0))
    shifted = _shift(hashed.withColumn("after", after), id_type, primes, bases)
    sums = [(F.sum(F.col("h")[i]) % p).alias(f"h{i}") for i, p in enumerate(primes)]
    joined = shifted.groupBy("row", "id", "n_bytes", "sha256").agg(*sums)
    joined = joined.select("id", "n_bytes", "sha256", F.array(*[F.col(f"h{i}") for i in range(len(primes))]).alias("h"))
    return short.unionByName(joined)


def _shift(df: DataFrame, id_type: str, primes: tuple[int, ...], bases: tuple[int, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [[x * pow(r, n, p) % p for x, r, p in zip(part, bases, primes, strict=True)] for part, n in zip(b.column("h").to_pylist(), b.column("after").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in ("row", "id", "n_bytes", "sha256")], pa.array(h, pa.list_(pa.int64()))], ["row", "id", "n_bytes", "sha256", "h"])

    return df.mapInArrow(run, f"row bigint, id {id_type}, n_bytes bigint, sha256 string, h array<bigint>")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES, primes: tuple[int, ...] = PRIMES, bases: tuple[int, ...] = BASES, salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    with scratch(docs.sparkSession):
        prints, groups = _grouped(docs, id_col, text_col, segment_bytes, primes, bases, salt_rows)
        alone = prints.select("id", "sha256").join(groups.select(F.col("id").alias("of_id"), F.col("sha256").alias("of_sha256"), "keep_id", "group_size"), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("sha256") == F.col("of_sha256")), "left")
        keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
        out = alone.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha256").alias("text_sha256"))
        return materialise(out, "dedup-result", keep=True)


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES, primes: tuple[int, ...] = PRIMES, bases: tuple[int, ...] = BASES, salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row of each group of equal texts, with the largest id; all columns are kept."""
    with scratch(docs.sparkSession):
        _, groups = _grouped(docs, id_col, text_col, segment_bytes, primes, bases, salt_rows)
        marks = groups.select("id", "sha256", F.col("id").eqNullSafe(F.col("keep_id")).alias("stays"), "times").where("times > 1 OR NOT stays")
        marks = materialise(marks.toDF("of_id", "of_sha256", "stays", "times"), "dedup-marks", keep=True)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(whole, F.col(f"`{id_col}`").alias("id"), F.sha2(whole_text(text_col), 256).alias("sha256"))
    rows = with_hit(rows, F.xxhash64("id", "sha256"), bitmap(marks, F.xxhash64("of_id", "of_sha256")))
    is_marked = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("sha256") == F.col("of_sha256"))
    # Of rows with equal id and text, which are all marked, one stays.
    judged = rows.where("hit").join(marks, is_marked, "left").where("stays IS NULL OR stays").groupBy("id", "sha256").agg(F.first("doc").alias("doc"))
    return rows.where("NOT hit").select("doc").unionByName(judged.select("doc")).select("doc.*")


def _grouped(docs: DataFrame, id_col: str, text_col: str, segment_bytes: int, primes: tuple[int, ...], bases: tuple[int, ...], salt_rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, sha256, key) of every row, and (id, sha256, keep_id, group_size, times) of every id and digest whose text several rows have; times: so many rows have both."""
    prints = fingerprint(docs, id_col, text_col, segment_bytes, primes, bases)
    key = F.concat_ws("-", F.col("n_bytes").cast("string"), F.array_join(F.transform("h", lambda x: x.cast("string")), "-"))
    prints = materialise(prints.select("id", "sha256", key.alias("key")), "dedup-prints")
    # Rows of one id and digest are one candidate from here on.
    known = prints.groupBy("id", "sha256", "key").agg(F.count("*").alias("times"))
    # Small tables are written before they meet a hot key: then they are broadcast, or the join's own shuffle can be split.
    repeated = materialise(prints.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"), "dedup-repeated")
    known = materialise(known.join(repeated, "key"), "dedup-known")
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.encode(whole_text(text_col), "UTF-8").alias("bytes"), F.sha2(whole_text(text_col), 256).alias("sha256"))
    pending, settled = known.select("id", "sha256", "key"), None
    while True:
        judged = _compare(_led(pending), text, segment_bytes, salt_rows)
        same = judged.where("same").select("id", "sha256", "key", "rep", "lead")
        settled = same if settled is None else settled.unionByName(same)
        pending = judged.where("NOT same").select("id", "sha256", "key")
        if pending.isEmpty():
            break
    # A group is named by its representative: the id and, as that may have several texts, the digest.
    settled = settled.toDF("set_id", "set_sha256", "key", "rep", "lead")
    grouped = known.withColumnRenamed("key", "of_key").join(settled, F.col("id").eqNullSafe(F.col("set_id")) & (F.col("sha256") == F.col("set_sha256")) & (F.col("of_key") == F.col("key")))
    grouped = materialise(grouped.select("id", "sha256", "times", "key", "rep", "lead"), "dedup-grouped")
    sizes = materialise(grouped.groupBy("key", "rep", "lead").agg(F.sum("times").alias("group_size")).toDF("k", "r", "l", "group_size"), "dedup-sizes")
    out = grouped.join(sizes, (F.col("key") == F.col("k")) & F.col("rep").eqNullSafe(F.col("r")) & (F.col("lead") == F.col("l")))
    return prints, materialise(out.select("id", "sha256", F.col("rep").alias("keep_id"), "group_size", "times"), "dedup-groups")


def _led(pending: DataFrame) -> DataFrame:
    """Adds rep, lead and n to pending(id, sha256, key): a key's largest id, of that the largest digest, and its number of rows."""
    best = F.max(F.struct(F.col("id").isNotNull().alias("named"), "id", "sha256")).alias("best")
    top = pending.groupBy("key").agg(best, F.count("*").alias("n")).select("key", F.col("best.id").alias("rep"), F.col("best.sha256").alias("lead"), "n")
    return materialise(pending.join(materialise(top, "dedup-top"), "key"), "dedup-pending")


def _compare(pending: DataFrame, text: DataFrame, chunk_bytes: int, salt_rows: int) -> DataFrame:
    """(id, sha256, key, rep, lead, same): every pending row against its representative, chunk by chunk.

    A row's identity is its id and digest, so that an id used by several texts does no harm.
    Of an id that has several texts of one fingerprint, one text is the representative.
    """
    who = ["id", "sha256"]
    is_rep = F.col("id").eqNullSafe(F.col("rep")) & (F.col("sha256") == F.col("lead"))
    cut = F.explode(F.sequence(F.lit(0), (F.greatest(F.octet_length("bytes") - 1, F.lit(0)) / chunk_bytes).cast("int")))
    part = F.substring(F.col("bytes"), F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))
    salts = F.ceil(F.col("n") / salt_rows).cast("int")
    asked = pending.where("n > 1").withColumnRenamed("id", "of_id").withColumnRenamed("sha256", "of_sha256")
    text = with_hit(text, F.xxhash64(*who), bitmap(asked, F.xxhash64("of_id", "of_sha256"))).where("hit").drop("hit")
    texts = text.join(asked, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("sha256") == F.col("of_sha256"))).drop("of_id", "of_sha256")
    members = texts.where(~is_rep).withColumn("salt", F.pmod(F.xxhash64(*who), salts).cast("int")).withColumn("chunk", cut).select(*who, "key", "rep", "lead", "salt", "chunk", part.alias("a"))
    reps = texts.where(is_rep).dropDuplicates(["key"]).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("chunk", cut).select("key", "salt", "chunk", part.alias("b"))
    judged = members.join(reps, ["key", "salt", "chunk"], "left").groupBy(*who, "key", "rep", "lead").agg(F.every(F.col("a").eqNullSafe(F.col("b"))).alias("same"))
    return materialise(judged.unionByName(pending.where(is_rep).select(*who, "key", "rep", "lead", F.lit(True).alias("same"))), "dedup-judged")
