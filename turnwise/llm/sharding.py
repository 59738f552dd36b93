"""Sharding by bytes: contiguous shards of nearly equal size, cut in global prefix sums.

Documents are put in the order of their ids and dealt into ranges; each range's total, summed
over the ranges before it, gives the range's offset, and a running sum inside the range the
document's. Only (id, size, checksum) travels, never a text. A document goes to the shard in
which its middle byte falls, so shards differ from the equal target by one document at most.
A document's slot is its place in its shard, from 0.

Defined results: null counts as no text and has size 1, so empty texts are spread as well.
Equal ids are ordered by checksum and size, null ids first. An empty table gives an empty
result. Only id and text are used, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from turnwise.session import materialise


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32): UTF-8 bytes plus 1, and the unsigned CRC-32 of the bytes."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard (null: this law moves rows when shards are added)."""
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["id", "text_crc32", "size"]
    # The ranges are written down once: their borders come from a sample, and both uses must see the same ones.
    laid = materialise(sized(docs, id_col, text_col).repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "shard-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: a few thousand, however many documents there are.
    totals = laid.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    whole = totals.agg(F.sum("bytes").alias("all_bytes"))
    starts = totals.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0")).join(whole)
    inside = Window.partitionBy("range").orderBy(*order)
    placed = laid.join(F.broadcast(starts), "range").select("id", "size", "text_crc32", (F.col("byte0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("at"), (F.col("row0") + F.row_number().over(inside) - 1).alias("nth"), "all_bytes")
    middle = F.expr(f"(2 * at + size) * {n_shards} div (2 * all_bytes)")
    placed = placed.withColumn("shard", F.least(middle, F.lit(n_shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - F.col("first")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
