"""Session factory and the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "turnwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library assumes: UTC, adaptive plans, Arrow transfer."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in spark.checkpoint.dir.

    Where that is unset, a local folder serves a session whose executors are threads of the
    driver (tests); on a cluster it would lose results, so the job fails instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/turnwise-{os.getuid()}"


#: Paths written inside the open `scratch` blocks, the innermost last.
_WRITTEN: ContextVar[tuple[list[str], ...]] = ContextVar("turnwise_written", default=())

#: Shuffle files go when their query ends; what is read again is a written table.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `materialise` writes inside the block are deleted at its end, but for those that it was told to keep: these belong to the block around it.

    Shuffle files of queries built inside the block are deleted as each query ends, so disk
    holds one query's shuffles and the tables still to be read.
    """
    paths: list[str] = []
    token = _WRITTEN.set((*_WRITTEN.get(), paths))
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)
        _WRITTEN.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    The lineage ends there: a lost executor costs a re-read, never a recomputation of
    what produced df, and later jobs see the same rows in the same blocks. `keep`: the
    table outlives the innermost `scratch` block, as it is the block's result.
    """
    path = f"{shared_dir(df.sparkSession)}/turnwise/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    blocks = _WRITTEN.get()[: -1 if keep else None]
    if blocks:
        blocks[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
