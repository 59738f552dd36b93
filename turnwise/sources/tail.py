"""Incremental tail of append-only logs: a streaming source that keeps a byte offset for each file.

A micro-batch reads the complete lines that files have gained since the batch before, each once;
a last line without its newline waits for the rest. The checkpoint holds, for each file, the
offset after its last complete line and a mark, the digest of the bytes just before it. A file that
is shorter than its offset, whose mark no longer fits, or that has gone was replaced: an error, or,
with `replaced` = "restart", it is read from its beginning. Large gains are cut into ranges of
`rangeBytes`, one for each task; a range owns the lines that begin in it.

Files are reached through Arrow's file systems, so a path may be local, shared or in an object
store. The driver lists the folder and reads the end of each file; the offsets grow with the
number of files, not with their lines. Names that begin with _ or . are not part of a log.

`fold` folds tailed entries to one row for each key. Lines that are not JSON objects, or have no
key, are left out; lines are decoded as UTF-8, wrong bytes replaced.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from turnwise.registry import register
from turnwise.session import shared_dir
from turnwise.sources.tables import table

SCHEMA = "path string, at bigint, line string"
RANGE_BYTES = 64 << 20
#: Bytes before an offset that its mark covers, of a step back for the last newline, and of a batch of lines.
MARK_BYTES, STEP_BYTES, BATCH_BYTES = 256, 64 << 10, 4 << 20


class LogReplaced(ValueError):
    """A file of the log no longer begins with what was read from it."""


@dataclass
class LineRange(InputPartition):
    """Lines of `path` that begin from `begin` to before `end`; `first`: `begin` is known to begin a line."""

    path: str
    begin: int
    end: int
    first: bool

    def __post_init__(self) -> None:
        super().__init__(self.path)


def _complete(f: pa.NativeFile, size: int) -> int:
    """The offset after the last newline; 0 without one."""
    end = size
    while end > 0:
        begin = max(0, end - STEP_BYTES)
        f.seek(begin)
        at = f.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return 0


def _mark(f: pa.NativeFile, at: int) -> str:
    begin = max(0, at - MARK_BYTES)
    f.seek(begin)
    return hashlib.sha256(f.read(at - begin)).hexdigest()[:16]


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.uri = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.restart = {"error": False, "restart": True}[options.get("replaced", "error")]

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        store, root = fs.FileSystem.from_uri(self.uri)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            return {"files": {}}
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(root))
        out = {}
        for x in sorted(files, key=lambda x: x.path):
            if x.is_file and x.base_name[0] not in "_.":
                with store.open_input_file(x.path) as f:
                    at = _complete(f, f.size())
                    if at:
                        out[x.path] = {"at": at, "mark": _mark(f, at)}
        return {"files": out}

    def _begin(self, store: fs.FileSystem, path: str, known: dict | None) -> int:
        """Where a file is to be read from."""
        if not known:
            return 0
        if store.get_file_info(path).is_file:
            with store.open_input_file(path) as f:
                if f.size() >= known["at"] and _mark(f, known["at"]) == known["mark"]:
                    return known["at"]
        if not self.restart:
            raise LogReplaced(f"{path} was truncated or replaced after {known['at']} bytes were read")
        return 0

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        store, _ = fs.FileSystem.from_uri(self.uri)
        out = []
        for path in sorted(start["files"].keys() | end["files"].keys()):
            begin = self._begin(store, path, start["files"].get(path))
            stop = end["files"].get(path, {"at": 0})["at"]
            for at in range(begin, stop, self.range_bytes):
                out.append(LineRange(path, at, min(at + self.range_bytes, stop), at == begin))
        return out

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.uri)
        with io.BufferedReader(store.open_input_file(partition.path), 1 << 20) as f:
            # From the byte before a range on, the rest of a line belongs to the range before.
            at = partition.begin - (not partition.first)
            f.seek(at)
            if not partition.first:
                at += len(f.readline())
            ats, lines, held = [], [], 0
            while at < partition.end:
                line = f.readline()
                ats.append(at)
                lines.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                at += len(line)
                held += len(line)
                if held >= BATCH_BYTES:
                    yield _batch(partition.path, ats, lines)
                    ats, lines, held = [], [], 0
            if ats:
                yield _batch(partition.path, ats, lines)


def _batch(path: str, ats: list[int], lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(ats)), pa.array(ats, pa.int64()), pa.array(lines, pa.string())], ["path", "at", "line"])


class LogTail(DataSource):
    """spark.readStream.format("log_tail"). Options: path (a file or a folder), rangeBytes, replaced ("error" or "restart")."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})


def tail(spark: SparkSession, path: str, state: str, out: str, **options: str) -> DataFrame:
    """Appends what the log has gained since the last call with this `state` folder to the Parquet table `out`, and returns that table."""
    spark.dataSource.register(LogTail)
    lines = spark.readStream.format("log_tail").options(path=path, **options).load()
    lines.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(SCHEMA).parquet(out)


ENTRY = "conversation_id string, call_id string, label string, graph_id string, reason string, at string"


def fold(lines: DataFrame, order: Sequence[str | Column] = ("path", "at")) -> DataFrame:
    """One row for each conversation_id: call_id the last set, label the first set, graphs the distinct ids in order of their first entry with its reason, first_seen_at, last_seen_at, entries."""
    e = lines.select(F.struct(*order).alias("pos"), F.from_json("line", ENTRY).alias("e")).select("pos", "e.*").where(F.coalesce("conversation_id", F.lit("")) != "")
    unset = lambda c: F.nullif(F.col(c), F.lit(""))
    placed = lambda c: F.when(unset(c).isNotNull(), F.col("pos"))
    heads = e.groupBy("conversation_id").agg(
        F.max_by("call_id", placed("call_id")).alias("call_id"),
        F.min_by("label", placed("label")).alias("label"),
        F.min_by("at", "pos").alias("first_seen_at"),
        F.max_by("at", "pos").alias("last_seen_at"),
        F.count("*").alias("entries"),
    )
    first = e.where(unset("graph_id").isNotNull()).groupBy("conversation_id", "graph_id").agg(F.min("pos").alias("pos"), F.min_by("reason", "pos").alias("reason"))
    graphs = first.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("pos", "graph_id", "reason"))).alias("g"))
    listed = F.transform("g", lambda x: F.struct(x["graph_id"].alias("graph_id"), x["reason"].alias("reason")))
    return heads.join(graphs, "conversation_id", "left").select(*heads.columns, F.coalesce(listed, F.array().cast("array<struct<graph_id:string,reason:string>>")).alias("graphs"))


@register(
    "st13_incremental_tail",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS k, event_id, event_type, 'c' || event_id AS call_id, event_id % 3 = 0 AS called, json_extract_string(props, '$.k') AS g FROM events),
    f AS (SELECT k, g, min(event_id) AS p FROM e WHERE g IS NOT NULL GROUP BY 1, 2)
    SELECT k AS conversation_id, max_by(call_id, event_id) FILTER (called) AS call_id, min_by(event_type, event_id) AS label, CAST(min(event_id) AS VARCHAR) AS first_seen_at, CAST(max(event_id) AS VARCHAR) AS last_seen_at, count(*) AS entries,
      coalesce((SELECT string_agg(g, ',' ORDER BY p) FROM f WHERE f.k = e.k), '') AS graphs
    FROM e GROUP BY k""",
)
def st13_incremental_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that grows between two runs over one checkpoint, folded by conversation in the order of the entries."""
    e = table(spark, sf_dir, "events")
    base = f"{shared_dir(spark)}/turnwise/tail-{uuid.uuid4().hex}"
    entry = F.struct(F.col("user_id").cast("string").alias("conversation_id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("call_id"), F.col("event_type").alias("label"), F.get_json_object("props", "$.k").alias("graph_id"), F.col("event_id").cast("string").alias("at"))
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).select(F.to_json(entry).alias("value")).write.mode("append").text(f"{base}/log")
        lines = tail(spark, f"{base}/log", f"{base}/state", f"{base}/lines")
    done = fold(lines, [F.get_json_object("line", "$.at").cast("bigint")])
    return done.withColumn("graphs", F.array_join("graphs.graph_id", ","))
