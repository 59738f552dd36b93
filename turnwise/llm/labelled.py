"""Labelled rows: which are held out, and a bounded sample of the others to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of the hash space in which the sample is drawn.
_SPACE = 1 << 20


def held_out(id_col: str) -> Column:
    """crc32 of the id as text leaves 1 when divided by 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, target: str, max_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text, y) of about max_rows labelled rows that are not held out, chosen by a hash of the id.

    The ids are broadcast: their number is bounded by max_rows (twice that at most, by chance).
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(target).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(target).cast("int")).alias("y"))
    n = known.count()
    share = min(_SPACE, _SPACE * max_rows // max(1, n))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(_SPACE)) < share)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id")
