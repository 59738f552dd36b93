"""Quality by attention-based multiple-instance learning.

A document is a bag of passages, PASSAGE_WORDS words each. A passage's description (shares of
kinds of characters, word lengths, repetition) is encoded by a small layer; a gated attention,
tanh times sigmoid, weighs the passages, and the weighted mean of their encodings is scored.
All parts are trained together on the documents' labels by gradient descent; no passage has a
label. The parameters are a few thousand numbers, fitted on MAX_TRAIN labelled rows that are
not held out, chosen by a hash of the id; every passage of every text is then encoded where it
is read.

Defined results: null, empty and blank texts are a bag of one passage of zeros. Rows of equal
id are scored each. Without labels of both classes all scores are the classes' share (0.5
without any). An empty table gives an empty result. Only id and text are used, so other
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnwise.llm.labelled import held_out, training_sample
from turnwise.llm.shingles import word_hashes
from turnwise.llm.text import text_slices, whole_text

MAX_TRAIN = 6_000
PASSAGE_WORDS = 64

_KINDS = {"upper": range(0x41, 0x5B), "digit": range(0x30, 0x3A), "shout": b"!", "symbol": b"*#$%&@^~=+", "bar": b"|<>{}[]\\", "stop": b".", "comma": b",;:", "mark": b"?'\"()-_/", "line": b"\n"}
FEATURES = len(_KINDS) + 9


def _kinds() -> np.ndarray:
    table = np.full(256, -1, np.int8)
    for i, members in enumerate(_KINDS.values()):
        table[list(members)] = i
    return table


def describe(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, index of its text), over a batch of texts; each text has a passage at least."""
    texts = text.cast(pa.large_string())
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    passages = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first = np.cumsum(passages) - passages
    of_text = np.repeat(np.arange(len(texts)), passages)
    out = np.zeros((len(of_text), FEATURES), np.float32)
    if not len(words):
        return out, of_text
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    kind = _kinds()[data]
    # Capitals of two bytes: C3 80 to C3 9E.
    kind[1:][(data[:-1] == 0xC3) & (data[1:] < 0x9F)] = 0
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    begins = ~space
    begins[1:] &= space[:-1]
    edges = (offsets - offsets[0])[:-1]
    edges = edges[edges < len(data)]
    begins[edges] = ~space[edges]
    starts = np.flatnonzero(begins)
    nth = np.arange(len(words)) - (np.cumsum(counts) - counts)[owner]
    home = first[owner] + nth // PASSAGE_WORDS
    n_words = np.bincount(home, minlength=len(of_text)).astype(np.float64)
    # A byte belongs to the passage of the word at or before it.
    lengths = np.diff(np.append(starts, len(data)))
    byte_home = np.repeat(home, lengths)
    tail = slice(starts[0], len(data))
    n_bytes = np.maximum(1, np.bincount(byte_home, minlength=len(of_text)))
    known = kind[tail] >= 0
    table = np.bincount(byte_home[known] * len(_KINDS) + kind[tail][known], minlength=len(of_text) * len(_KINDS)).reshape(-1, len(_KINDS))
    k = len(_KINDS)
    out[:, :k] = np.sqrt(table / n_bytes[:, None])
    letters = np.add.reduceat((~space[tail]).astype(np.int64), starts - starts[0])
    some = np.maximum(1, n_words)
    mean = np.bincount(home, letters, len(of_text)) / some
    out[:, k] = mean / 10
    out[:, k + 1] = np.sqrt(np.maximum(0, np.bincount(home, letters.astype(np.float64) ** 2, len(of_text)) / some - mean**2)) / 10
    same = np.zeros(len(words))
    same[1:] = (words[1:] == words[:-1]) & (home[1:] == home[:-1])
    out[:, k + 2] = np.bincount(home, same, len(of_text)) / some
    order = np.lexsort((words, home))
    new = np.ones(len(words))
    new[1:] = (words[order][1:] != words[order][:-1]) | (home[order][1:] != home[order][:-1])
    out[:, k + 3] = np.bincount(home[order], new, len(of_text)) / some
    order = np.lexsort((words, owner))
    new = np.ones(len(words))
    new[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    out[:, k + 4] = (np.bincount(owner[order], new, len(texts)) / np.maximum(1, counts))[of_text]
    out[:, k + 5] = np.bincount(byte_home, data[tail] > 0x7F, len(of_text)) / n_bytes
    out[:, k + 6] = np.bincount(home, letters > 20, len(of_text)) / some
    out[:, k + 7] = np.log1p(n_words) / 4
    out[:, k + 8] = np.log1p(counts)[of_text] / 8
    return out, of_text


@dataclass
class Attention:
    """Encoder (e), gates (v, u, w) and score (c) of the bag."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def new(cls, x: np.ndarray, hidden: int = 24, gate: int = 12, seed: int = 7) -> Attention:
        rng = np.random.default_rng(seed)
        shape = {"e": (x.shape[1] + 1, hidden), "v": (hidden, gate), "u": (hidden, gate), "w": (gate,), "c": (hidden + 1,)}
        return cls({k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shape.items()}, x.mean(0), x.std(0) + 0.05)

    def forward(self, x: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        h = np.tanh(z @ p["e"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-h @ p["u"]))
        a = (t * s) @ p["w"]
        n = np.diff(np.append(start, len(x)))
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, start), n))
        a /= np.repeat(np.add.reduceat(a, start), n)
        bag = np.add.reduceat(h * a[:, None], start, axis=0)
        y = 1 / (1 + np.exp(-np.clip(bag @ p["c"][:-1] + p["c"][-1], -30, 30)))
        return {"z": z, "h": h, "t": t, "s": s, "a": a, "n": n, "bag": bag, "y": y}

    def gradient(self, f: dict[str, np.ndarray], start: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, h, t, s, a, n = self.p, f["h"], f["t"], f["s"], f["a"], f["n"]
        err = (f["y"] - y) / len(y)
        bag = np.repeat(err[:, None] * p["c"][:-1], n, axis=0)
        da = (bag * h).sum(1)
        da = a * (da - np.repeat(np.add.reduceat(a * da, start), n))
        dg = da[:, None] * p["w"]
        dt, ds = dg * s * (1 - t**2), dg * t * s * (1 - s)
        dh = (bag * a[:, None] + dt @ p["v"].T + ds @ p["u"].T) * (1 - h**2)
        return {"e": f["z"].T @ dh, "v": h.T @ dt, "u": h.T @ ds, "w": (t * s).T @ da, "c": np.append(f["bag"].T @ err, err.sum())}

    def fit(self, x: np.ndarray, start: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.02, decay: float = 1e-4) -> Attention:
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for i in range(1, steps + 1):
            grad = self.gradient(self.forward(x, start), start, y)
            for k, g in grad.items():
                g = g + decay * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = self.p[k] - rate * m[k] / (1 - 0.9**i) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
        return self


def _bags(rows: DataFrame) -> DataFrame:
    """(id, y, x): each row's passages, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            x, of_text = describe(batch.column("text"))
            ends = np.cumsum(np.bincount(of_text, minlength=batch.num_rows)) * FEATURES
            bags = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(x.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), bags], ["id", "y", "x"])

    return rows.select("id", "y", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, y int, x array<float>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "quality", max_train: int = MAX_TRAIN) -> Attention | float:
    """The model, or the share of label 1 where one class is missing."""
    rows = _bags(training_sample(docs, labels, target, max_train, id_col, text_col)).orderBy("id").toArrow()
    y = np.array(rows.column("y").to_pylist(), float)
    if len(y) == 0 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    bags = [np.array(b, np.float32).reshape(-1, FEATURES) for b in rows.column("x").to_numpy(zero_copy_only=False)]
    start = np.cumsum([0, *map(len, bags)])[:-1]
    x = np.concatenate(bags).astype(np.float64)
    return Attention.new(x).fit(x, start, y)


def score_documents(docs: DataFrame, model: Attention | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, held_out, score and predicted of every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), held_out(id_col).alias("held_out"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 2 << 20):
            if isinstance(model, float):
                y = np.full(batch.num_rows, model)
            else:
                x, of_text = describe(batch.column("text"))
                y = model.forward(x.astype(np.float64), np.flatnonzero(np.append(True, of_text[1:] != of_text[:-1])))["y"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(y), pa.array((y >= threshold).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
