"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(name: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def release_memory() -> None:
    """Gives memory that a finished task no longer uses back to the system, since Python workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 4 << 20, max_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that one slice holds about max_bytes of `column`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        at = total = 0
        for i, n in enumerate(sizes):
            if i > at and (total + n > max_bytes or i - at >= max_rows):
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        yield batch.slice(at)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that clashing extra columns of the input do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])
