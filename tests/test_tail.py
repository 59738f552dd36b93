"""The log tail over files that grow, wait, shrink and change."""

from __future__ import annotations

import pytest
from pyspark.errors import StreamingQueryException

from turnwise.sources.tail import fold, tail


class Log:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        (folder / "log").mkdir()

    def put(self, name, data, mode="ab"):
        with open(self.folder / "log" / name, mode) as f:
            f.write(data)

    def lines(self, **options):
        df = tail(self.spark, f"file://{self.folder}/log", f"file://{self.folder}/state", f"file://{self.folder}/out", **options)
        return sorted((r.path.rpartition("/")[2], r.at, r.line) for r in df.collect())


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, tmp_path)


def test_gains_are_read_once_and_a_half_line_waits(log):
    assert log.lines() == []
    log.put("a", b"one\ntw")
    assert log.lines() == [("a", 0, "one")]
    log.put("a", b"o\r\n\nfour")
    log.put("b", "ünï\n".encode() + b"\xff\n")
    log.put("_hidden", b"no\n")
    grown = [("a", 0, "one"), ("a", 4, "two"), ("a", 9, ""), ("b", 0, "ünï"), ("b", 6, "�")]
    assert log.lines() == grown
    assert log.lines() == grown
    log.put("a", b"\n")
    assert log.lines() == sorted([*grown, ("a", 10, "four")])


@pytest.mark.parametrize("size", ["1", "3", "7", "1000"])
def test_ranges_share_lines_without_loss(log, size):
    log.put("a", b"".join(b"%d\n" % i for i in range(120)) + b"\n\nlong line over several ranges\nrest")
    want = [str(i) for i in range(120)] + ["", "", "long line over several ranges"]
    assert [x for _, _, x in sorted(log.lines(rangeBytes=size), key=lambda r: r[1])] == want


@pytest.mark.parametrize("change", ["shorter", "other", "gone"])
def test_a_replaced_file_is_an_error_or_read_anew(log, change):
    log.put("a", b"one\ntwo\n")
    log.put("b", b"x\n")
    assert len(log.lines()) == 3
    if change == "gone":
        (log.folder / "log" / "a").unlink()
        log.put("b", b"y\n")
    else:
        log.put("a", {"shorter": b"new\n", "other": b"ONE\nTWO\nthree\n"}[change], "wb")
    with pytest.raises(StreamingQueryException, match="truncated or replaced"):
        log.lines()
    # The failed batch is planned in the checkpoint; it runs again under the other rule.
    again = log.lines(replaced="restart")
    assert len(again) == 3 + {"shorter": 1, "other": 3, "gone": 1}[change]


def test_fold_keeps_first_and_last(spark):
    rows = [
        ("f", 0, '{"conversation_id": "k", "label": "", "graph_id": "g2", "reason": "new", "at": "t0"}'),
        ("f", 9, '{"conversation_id": "k", "call_id": "c1", "label": "first", "graph_id": "g1", "at": "t1"}'),
        ("f", 20, "not json"),
        ("f", 30, '{"call_id": "lost"}'),
        ("f", 40, '{"conversation_id": "k", "call_id": "c2", "label": "second", "graph_id": "g2", "reason": "again", "at": "t2"}'),
        ("f", 50, '{"conversation_id": "k", "call_id": null, "at": "t3"}'),
        ("f", 60, '{"conversation_id": "only"}'),
    ]
    got = {r.conversation_id: r for r in fold(spark.createDataFrame(rows, "path string, at bigint, line string")).collect()}
    k = got["k"]
    assert (k.call_id, k.label, k.first_seen_at, k.last_seen_at, k.entries) == ("c2", "first", "t0", "t3", 4)
    assert [tuple(g) for g in k.graphs] == [("g2", "new"), ("g1", None)]
    assert got["only"].graphs == [] and len(got) == 2
    assert fold(spark.createDataFrame([], "path string, at bigint, line string"), ["at"]).count() == 0
