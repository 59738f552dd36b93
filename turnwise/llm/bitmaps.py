"""Which rows may be among wanted ones: a bitmap of hashes of fixed size, joined by broadcast.

A shuffle of all texts for the sake of a few is avoided this way at every size of the table:
the bitmap has at most SLOTS bits (WORDS rows of two numbers, some 24 MB), whatever the number
of keys. Rows that hit it by chance are told apart by the exact join that follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SLOTS = 1 << 26
WORDS = SLOTS // 64


def _place(key: Column) -> tuple[Column, Column]:
    slot = F.pmod(key, F.lit(SLOTS))
    return F.shiftright(slot, 6), (slot % 64).cast("int")


def bitmap(keys: DataFrame, key: Column) -> DataFrame:
    """(word, bits) of the keys, which are 64-bit hashes."""
    word, bit = _place(key)
    one = F.expr("shiftleft(1L, bit)")
    return keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(one).alias("bits"))


def with_hit(rows: DataFrame, key: Column, bits: DataFrame) -> DataFrame:
    """Adds `hit`: whether the row's key may be among the bitmap's."""
    word, bit = _place(key)
    asked = rows.withColumn("at_word", word).withColumn("at_bit", bit)
    found = asked.join(F.broadcast(bits), F.col("at_word") == F.col("word"), "left")
    hit = F.coalesce(F.getbit("bits", F.col("at_bit")) == 1, F.lit(False))
    return found.withColumn("hit", hit).drop("at_word", "at_bit", "word", "bits")
