"""Vectors: cosine, search, nearest neighbours of a stated query set, votes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnwise.registry import register
from turnwise.sources.tables import table

#: Vectors of one block of the query set, and of one pack of the bank.
BLOCK, PACK = 1024, 8192


def doubles(v: str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Between 0 and 1; 0 where a vector is all zeros."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / lengths)))


_COSINE = "CASE WHEN {a} * {b} = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) / ({a} * {b}))) END".format(
    a="sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))", b="sqrt(list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[])))"
)


@register("fn10_cosine", f"SELECT vec_id, round({_COSINE}, 9) AS cosine FROM embeddings, (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)")
def fn10_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vector with the first one."""
    e = table(spark, sf_dir, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(doubles("embedding").alias("q"))
    return e.join(F.broadcast(q)).select("vec_id", F.round(cosine(doubles("embedding"), F.col("q")), 9).alias("cosine"))


@register("fn11_l2_norm", "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS l2 FROM embeddings")
def fn11_l2_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(doubles("embedding")), 6).alias("l2"))


@register(
    "jn20_vector_search",
    "SELECT vec_id, label FROM embeddings, (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1) ORDER BY round(" + _COSINE + ", 9) DESC, vec_id LIMIT 20",
)
def jn20_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of one query (a top-k report)."""
    e = table(spark, sf_dir, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(doubles("embedding").alias("q"))
    return e.join(F.broadcast(q)).orderBy(F.round(cosine(doubles("embedding"), F.col("q")), 9).desc(), "vec_id").limit(20).select("vec_id", "label")


def _packed(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Vectors in packs of about `size`, one pack to a row; their number follows the table's, so a row's bytes do not."""
    packs = max(1, -(-vectors.count() // size))
    dealt = vectors.withColumn("pack", F.pmod(F.xxhash64("vec_id"), F.lit(packs)))
    return dealt.groupBy("pack").agg(F.collect_list(F.struct("vec_id", "label", "embedding")).alias(name)).select(name)


def nearest(bank: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, label, cosine): exact k nearest bank vectors of each query.

    A stated query set meets the whole bank block by block: each pack of the bank is multiplied
    with each block of queries, and only the pack's k best rows of a query are shuffled.
    """
    columns = ("vec_id", "label", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(pack: pa.StructArray) -> tuple[np.ndarray, pa.StructArray]:
            return np.asarray(pack.field("embedding").flatten(), float).reshape(len(pack), -1), pack

        for batch in batches:
            for row in range(batch.num_rows):
                (left, q), (right, b) = matrix(batch.column("q")[row].values), matrix(batch.column("b")[row].values)
                ids, labels, asked = (np.asarray(x) for x in (b.field("vec_id"), b.field("label"), q.field("vec_id")))
                cos = left @ right.T
                for i, near in enumerate(cos):
                    # The k-th best score first, then ties by id.
                    at = np.flatnonzero(near >= np.partition(near, -k)[-k]) if len(near) > k else np.arange(len(near))
                    best = at[np.lexsort((ids[at], -near[at]))[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), asked[i]), pa.int64()), pa.array(ids[best], pa.int64()), pa.array(labels[best], pa.int32()), pa.array(near[best])], ["query_id", "vec_id", "label", "cosine"])

    met = _packed(bank.select(*columns), PACK, "b").join(_packed(queries.select(*columns), BLOCK, "q")).mapInArrow(run, "query_id bigint, vec_id bigint, label int, cosine double")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return met.withColumn("nth", nth).where(F.col("nth") <= k)


@register(
    "jn19_knn_join",
    """SELECT q.vec_id AS query_id, b.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS cosine FROM embeddings q JOIN embeddings b ON q.vec_id % 20 = 0 AND b.vec_id <> q.vec_id
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) <= 10""",
)
def jn19_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbours of every vector whose id is divisible by 20, among all others."""
    e = table(spark, sf_dir, "embeddings")
    found = nearest(e, e.where("vec_id % 20 = 0"), 11).where("vec_id <> query_id")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return found.withColumn("m", nth).where("m <= 10").select("query_id", "vec_id", F.round("cosine", 9).alias("cosine"))


@register(
    "fn13_knn_vote",
    """WITH n AS (SELECT q.vec_id AS query_id, b.label, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings q JOIN embeddings b ON q.vec_id % 20 = 0 AND b.vec_id <> q.vec_id
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY c DESC, b.vec_id) <= 10), w AS (SELECT *, exp((c - max(c) OVER (PARTITION BY query_id)) / 0.1) AS w FROM n), s AS (SELECT query_id, label, sum(w) AS s FROM w GROUP BY 1, 2)
SELECT query_id, label, round(s / sum(s) OVER (PARTITION BY query_id), 6) AS share FROM s""",
)
def fn13_knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels' shares among ten neighbours, weighted by a softmax of the cosine."""
    e = table(spark, sf_dir, "embeddings")
    found = nearest(e, e.where("vec_id % 20 = 0"), 11).where("vec_id <> query_id")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    ten = found.withColumn("m", nth).where("m <= 10")
    per = Window.partitionBy("query_id")
    w = ten.withColumn("w", F.exp((F.col("cosine") - F.max("cosine").over(per)) / 0.1))
    s = w.groupBy("query_id", "label").agg(F.sum("w").alias("s"))
    return s.select("query_id", "label", F.round(F.col("s") / F.sum("s").over(per), 6).alias("share"))


#: Dimensions of the hashing scheme, and its name: vectors of different schemes are not compared.
HASH_SCHEME, HASH_DIMENSIONS = "md5-256-v1", 256


#: Slots of so many tokens and pairs of one size of the scheme are remembered in a task.
KNOWN = 500_000

_TOKEN, _ENDING = re.compile("[a-z0-9]+"), re.compile("(?:ing|ed|es|s|ly)$")


def hashed_slots(text: str, dimensions: int, known: dict[str, int]) -> tuple[list[int], int]:
    """The dimensions of a lower-case text's tokens and then of its pairs of neighbours, and the number of tokens; those of over four letters without a common ending."""
    tokens = [_ENDING.sub("", t) if len(t) > 4 else t for t in _TOKEN.findall(text)]
    slots = []
    for key in (*tokens, *map("_".join, zip(tokens, tokens[1:]))):
        at = known.get(key)
        if at is None:
            if len(known) >= KNOWN:
                known.clear()
            at = known[key] = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % dimensions
        slots.append(at)
    return slots, len(tokens)


def hashing_embedding(texts: DataFrame, id_col: str, text_col: str = "text", dimensions: int = HASH_DIMENSIONS) -> DataFrame:
    """(id, vector): a unit vector of hashed tokens (1 each) and pairs of neighbours (a half each) for each row; all zeros for a text without tokens.

    Each row by itself, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                sums = np.zeros((part.num_rows, dimensions))
                for i, text in enumerate(part.column("text")):
                    slots, n = hashed_slots(text.as_py(), dimensions, known)
                    if n:
                        halves = np.ones(len(slots))
                        halves[:n] = 2
                        sums[i] = np.bincount(slots, halves, dimensions)
                lengths = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
                vectors = sums / np.where(lengths == 0, 1, lengths)
                offsets = np.arange(0, (part.num_rows + 1) * dimensions, dimensions, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))], ["id", "vector"])

    rows = texts.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>").withColumnRenamed("id", id_col)


@register(
    "fn12_hashing_embedder",
    """WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: CASE WHEN length(x) > 4 THEN regexp_replace(x, '(?:ing|ed|es|s|ly)$', '') ELSE x END) AS t FROM documents),
    k AS (SELECT doc_id, unnest(t) AS key, 2 AS h FROM t UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])) AS key, 1 AS h FROM t WHERE len(t) > 1),
    s AS (SELECT doc_id, CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % 256 AS slot, sum(h) AS n FROM k GROUP BY 1, 2),
    l AS (SELECT doc_id, sqrt(sum(n * n)) AS length, count(*) AS used, arg_max(slot, (n, slot)) AS top, max(n) AS n FROM s GROUP BY 1)
    SELECT doc_id, CAST(coalesce(used, 0) AS BIGINT) AS used, CAST(coalesce(top, 255) AS INTEGER) AS top, round(coalesce(n / length, 0), 9) AS weight FROM documents LEFT JOIN l USING (doc_id)""",
)
def fn12_hashing_embedder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document's vector the slots in use, the heaviest (the last of equals) and its weight."""
    v = hashing_embedding(table(spark, sf_dir, "documents"), "doc_id")
    top = F.array_max(F.transform("vector", lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    return v.select("doc_id", F.size(F.filter("vector", lambda x: x > 0)).cast("bigint").alias("used"), top.alias("top")).select("doc_id", "used", F.col("top.i").alias("top"), F.round("top.w", 9).alias("weight"))
