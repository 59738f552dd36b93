"""Alignment of two tokenizers' tokens over a corpus, by id-striped dense count matrices.

Tokens of A and B lie over the same bytes. A pair of token occurrences is a link if their
ranges overlap; a pair of ids counts its links over the corpus; of the A ids, the best for a B
id are those of its highest count.

Tokenizing: a text is cut at spaces where neither tokenizer can merge across; each piece is
tokenized by the libraries once for a task, and a text's tokens, groups and links are those of
its pieces. Some hundred texts make a page; a page's links leave the task as one row for each
stripe of B ids (id modulo the number of stripes), the distinct (B id, A id, document) with
their numbers, compressed. The task also sums its pairs over all its pages.

Counting: the tasks' sums are dealt by stripe and added into a dense matrix of the stripe's B
ids by all A ids with np.add.at; its rows' maxima give the best. Scoring: a stripe's
matrix and its pages are dealt to the same partition, the matrix sorted before them, so each
page is scored as it streams by. A stripe with many bytes of pages is dealt to several cells, each with
a copy of the matrix, so that a frequent id does not hold one task. Each task returns sums by
document. The number of stripes depends on the vocabularies alone: a matrix has `MATRIX_BYTES` at most.

Defined results: texts that are null or empty, or whose A or B bytes do not join to a space and
the text, have no tokens: all numbers are 0 and the digest is ''. Repeated rows are returned
and counted each. Very long texts are tokenized whole. Equal counts are all best. An empty
table gives an empty result. Only id and text are used, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from turnwise.llm.byte_bpe import byte_characters
from turnwise.llm.text import text_slices, whole_text
from turnwise.session import materialise, scratch

#: Bytes of a stripe's matrix.
MATRIX_BYTES = 24 << 20
#: Bytes of compressed pages in a cell.
CELL_BYTES = 32 << 20
#: Bytes of text and rows of a page.
PAGE_BYTES, PAGE_ROWS = 2 << 20, 1024
#: Pieces that a task remembers, and pairs it sums before it sends them on.
PIECES, PAIRS = 300_000, 1_500_000
#: Pieces that are tokenized in one text.
TOGETHER = 64

#: A space after one of these characters starts a new piece; others may be white space to a tokenizer.
_SOLID = frozenset(map(chr, range(0x21, 0x7F)))


def _solid(text: str) -> bool:
    return text[-1:] in _SOLID or text[-1:].isalnum()


def pieces(text: str) -> list[str]:
    """A text that begins with a space, cut before spaces that follow a solid character and do not end the text."""
    out: list[str] = []
    solid = False
    for word in text.split(" ")[1:]:
        if solid and word:
            out.append(" " + word)
        elif out:
            out[-1] += " " + word
        else:
            out.append(" " + word)
        solid = _solid(word)
    return out


class ByteLevelA:
    """A byte-level BPE of the tokenizers library: ids of texts, bytes of ids."""

    def __init__(self, content: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(content)
        pre = spec.get("pre_tokenizer") or {}
        #: Cut by its own pattern first, in which a space after a solid character starts a match.
        self.cuts = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        back = {c: b for b, c in byte_characters().items()}
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.size)]
        self.bytes = [bytes(map(back.__getitem__, t)) if all(c in back for c in t) else t.encode() for t in names]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PiecesB:
    """A sentencepiece BPE with byte fallback, which puts a space before a text itself."""

    def __init__(self, content: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(content)
        rules = spec.normalizer_spec
        #: No piece reaches over the space between two words, and the text is taken as it is.
        self.cuts = spec.trainer_spec.model_type == 2 and not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and not any(re.search("[^▁]▁", x) for x in names)
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind: type, width: tuple[int, ...] = ()) -> None:
        self.held, self.n = np.empty((1024, *width), kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            wider = np.empty((max(2 * len(self.held), self.n + len(values)), *self.held.shape[1:]), self.held.dtype)
            wider[: self.n] = self.held[: self.n]
            self.held = wider
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)

    def all(self) -> np.ndarray:
        return self.held[: self.n]


def _fits(ids: list[list[int]], names: list[bytes], raw: list[bytes]) -> list[bool]:
    """Whether the tokens of each text join to its bytes."""
    return [b"".join(map(names.__getitem__, x)) == r for x, r in zip(ids, raw, strict=True)]


class Aligner:
    """Tokens, groups and links of pieces, each piece worked out once until the store is full."""

    def __init__(self, a: ByteLevelA, b: PiecesB) -> None:
        self.a, self.b = a, b
        self.cuts = a.cuts and b.cuts
        self.lengths = [np.array([len(x) for x in side.bytes], np.int64) for side in (a, b)]
        #: An id in decimal with what follows it: inside a group and at its end, first of A, then of B.
        self.words = [f"{i}{mark}" for side, marks in ((a, ",|"), (b, ",;")) for mark in marks for i in range(side.size)]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers = Grown(np.int64, (3,))  # A tokens (-1: the bytes differ), B tokens, groups
        self.starts = Grown(np.int64)
        self.starts.add(np.zeros(1, np.int64))
        self.links = Grown(np.uint64)  # B id << 32 | A id

    def learn(self, new: list[str]) -> None:
        """All new pieces at once: laid end to end, both sides cut the same bytes, and each stretch between two cuts of either side is one link.

        Pieces that end in a solid character are tokenized many in one text, since neither tokenizer
        merges across to the next one; a text whose bytes differ is taken apart again.
        """
        firm = [x for x in new if self.cuts and _solid(x)]
        groups = [firm[i : i + TOGETHER] for i in range(0, len(firm), TOGETHER)]
        groups += [[x] for x in new if not (self.cuts and _solid(x))]
        a, b, good = self._tokens(groups)
        apart = [[x] for g, ok in zip(groups, good, strict=True) if not ok and len(g) > 1 for x in g]
        lost = [g[0] for g, ok in zip(groups, good, strict=True) if not ok and len(g) == 1]
        fine = [(g, x, y) for g, x, y, ok in zip(groups, a, b, good, strict=True) if ok]
        if apart:
            a, b, good = self._tokens(apart)
            fine += [(g, x, y) for g, x, y, ok in zip(apart, a, b, good, strict=True) if ok]
            lost += [g[0] for g, ok in zip(apart, good, strict=True) if not ok]
        kept = [x for g, _, _ in fine for x in g]
        for piece in (*kept, *lost):
            self.known[piece] = len(self.known)
        sizes = np.array([len(x.encode()) for x in kept], np.int64)
        sides = [np.fromiter(itertools.chain.from_iterable(f[i] for f in fine), np.int64) for i in (1, 2)]
        ends = [np.cumsum(lengths[ids]) for ids, lengths in zip(sides, self.lengths, strict=True)]
        cuts = np.union1d(*ends)
        at = [np.searchsorted(e, cuts) for e in ends]
        both = (ends[0][at[0]] == cuts) & (ends[1][at[1]] == cuts) if len(cuts) else np.empty(0, bool)
        shared = cuts[both]
        borders = np.cumsum(sizes)
        per_piece = lambda places: np.diff(np.searchsorted(places, borders, "right"), prepend=0)
        n_a, n_b = map(per_piece, ends)
        self.numbers.add(np.column_stack([n_a, n_b, per_piece(shared)]))
        self.numbers.add(np.tile(np.array([-1, 0, 0], np.int64), (len(lost), 1)))
        begin = self.links.n + np.cumsum(per_piece(cuts))
        self.starts.add(np.append(begin, np.full(len(lost), begin[-1] if len(begin) else self.links.n)))
        self.links.add(sides[1][at[1]].astype(np.uint64) << np.uint64(32) | sides[0][at[0]].astype(np.uint64))
        # Of each group A's ids, then B's.
        group = [np.searchsorted(shared, e) for e in ends]
        last = [shared[g] == e if len(e) else np.empty(0, bool) for g, e in zip(group, ends, strict=True)]
        word = np.concatenate([sides[0] + last[0] * self.a.size, 2 * self.a.size + sides[1] + last[1] * self.b.size])
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        said = list(map(self.words.__getitem__, word[order].tolist()))
        lo = 0
        for n in (n_a + n_b).tolist():
            self.groups.append("".join(said[lo : lo + n])[:-1])
            lo += n
        self.groups += [""] * len(lost)

    def _tokens(self, groups: list[list[str]]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """A's and B's ids of each group's text, and whether both join to its bytes."""
        texts = ["".join(g) for g in groups]
        raw = [t.encode() for t in texts]
        a, b = self.a.encode(texts), self.b.encode(texts)
        return a, b, [x and y for x, y in zip(_fits(a, self.a.bytes, raw), _fits(b, self.b.bytes, raw), strict=True)]

    def page(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """((n_a, n_b, n_groups, n_links, digest) of each text, and the texts' distinct links: pair, text, number), pairs ascending."""
        cut = [(pieces(" " + t) if self.cuts else [" " + t]) if t else [] for t in texts]
        distinct = set().union(*cut)
        if len(self.known) + len(distinct) > PIECES:
            self.clear()
        if new := sorted(distinct.difference(self.known)):
            self.learn(new)
        numbers, starts, flat = self.numbers.all(), self.starts.all(), self.links.all()
        at = [list(map(self.known.__getitem__, parts)) for parts in cut]
        sizes = np.array([len(x) for x in at], np.int64)
        ids = np.fromiter(itertools.chain.from_iterable(at), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(at)), sizes)
        known = sizes > 0
        known[owner[numbers[ids, 0] < 0]] = False
        n_links = starts[1:] - starts[:-1]
        sums = [np.bincount(owner, x[ids], len(at)).astype(np.int64).tolist() for x in (*numbers.T, n_links)]
        rows = [(*x, hashlib.sha256(";".join(map(self.groups.__getitem__, own)).encode()).hexdigest()) if ok else (0, 0, 0, 0, "") for own, ok, *x in zip(at, known.tolist(), *sums, strict=True)]
        here = known[owner]
        # Distinct pieces of each text, with how often it has them.
        both, times = np.unique(owner[here] * (len(starts) + 1) + ids[here], return_counts=True)
        texts_of, found = np.divmod(both, len(starts) + 1)
        if not len(found):
            return rows, *[np.empty(0, t) for t in (np.uint64, np.int64, np.int64)]
        lengths = starts[found + 1] - starts[found]
        spread = np.repeat(np.arange(len(found)), lengths)
        places = np.arange(len(spread)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[found][spread]
        pair, text, number = flat[places], texts_of[spread], times[spread]
        order = np.lexsort((text, pair))
        pair, text, number = pair[order], text[order], number[order]
        first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])))
        return rows, pair[first], text[first], np.add.reduceat(number, first)


@lru_cache(maxsize=1)
def _aligner(a_content: bytes, b_content: bytes) -> Aligner:
    """Tokenizers are loaded once for a worker process; what a task learnt is dropped at its end."""
    return Aligner(ByteLevelA(a_content), PiecesB(b_content))


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in columns))


def _unpack(packed: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


class Stripes:
    """Which stripe and matrix row a B id has."""

    def __init__(self, a_size: int, b_size: int, matrix_bytes: int) -> None:
        self.a_size = a_size
        self.rows = max(1, min(b_size, matrix_bytes // (8 * a_size)))
        self.count = -(-b_size // self.rows)

    def split(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, stripes present, borders): links by stripe, inside it by B id."""
        stripe = (pair >> np.uint64(32)).astype(np.int64) % self.count
        order = np.argsort(stripe, kind="stable")
        present, borders = np.unique(stripe[order], return_index=True)
        return order, present, np.append(borders, len(pair))

    def cell(self, pair: np.ndarray) -> np.ndarray:
        """The place in the stripe's matrix, row by row."""
        return (pair >> np.uint64(32)).astype(np.int64) // self.count * self.a_size + (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)


_PAGES = "stripe int, page bigint, kind int, bytes bigint, packed binary, ids array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, digests array<string>"
_TEXTS, _LINKS, _PAIRS = 0, 1, 2


def _tokenize(rows: DataFrame, a_content: bytes, b_content: bytes, matrix_bytes: int) -> DataFrame:
    """Pages: a row of kind _TEXTS with its documents, rows of kind _LINKS by stripe; and rows of kind _PAIRS, the task's sums by stripe."""
    shipped = rows.sparkSession.sparkContext.broadcast((a_content, b_content))
    names = ["stripe", "page", "kind", "bytes", "packed", "ids", "n_a", "n_b", "n_groups", "n_links", "digests"]

    def by_stripe(stripes: Stripes, page: int, kind: int, pair: np.ndarray, *more: np.ndarray) -> Iterator[dict]:
        order, present, borders = stripes.split(pair)
        columns = [stripes.cell(pair).astype("<u8"), *more]
        for stripe, lo, hi in zip(present.tolist(), borders[:-1], borders[1:], strict=True):
            here = order[lo:hi]
            gaps = np.diff(columns[0][here], prepend=np.uint64(0)).astype("<u4" if kind == _LINKS else "<u8")
            packed = _pack(gaps, *[x[here] for x in columns[1:]])
            yield {"stripe": stripe, "page": page, "kind": kind, "bytes": len(packed), "packed": packed}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shipped.value)
        aligner.clear()
        stripes = Stripes(aligner.a.size, aligner.b.size, matrix_bytes)
        page, schema = TaskContext.get().partitionId() << 32, None
        held_pairs, held_sums = [], []
        for batch in text_slices(batches, "text", PAGE_BYTES, PAGE_ROWS):
            ids = batch.column("id")
            lists = {n: pa.list_(pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")}
            kinds = {"stripe": pa.int32(), "page": pa.int64(), "kind": pa.int32(), "bytes": pa.int64(), "packed": pa.binary(), "ids": pa.list_(ids.type)} | lists | {"digests": pa.list_(pa.string())}
            schema = pa.schema([(n, kinds[n]) for n in names])
            texts, pair, text, number = aligner.page(batch.column("text").to_pylist())
            n_a, n_b, n_groups, n_links, digests = map(list, zip(*texts, strict=True))
            rows = [{"stripe": -1, "page": page, "kind": _TEXTS, "ids": ids.to_pylist(), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "digests": digests}]
            rows += by_stripe(stripes, page, _LINKS, pair, text.astype("<u2"), number.astype("<u4"))
            keys, sums = _summed(pair, number)
            held_pairs.append(keys)
            held_sums.append(sums)
            if sum(map(len, held_pairs)) > PAIRS:
                keys, sums = _summed(np.concatenate(held_pairs), np.concatenate(held_sums))
                held_pairs, held_sums = [keys], [sums]
                if len(keys) > PAIRS // 2:
                    rows += by_stripe(stripes, page, _PAIRS, keys, sums.astype("<i8"))
                    held_pairs, held_sums = [], []
            yield pa.RecordBatch.from_pylist(rows, schema)
            page += 1
        aligner.clear()
        if held_pairs:
            keys, sums = _summed(np.concatenate(held_pairs), np.concatenate(held_sums))
            yield pa.RecordBatch.from_pylist(list(by_stripe(stripes, page, _PAIRS, keys, sums.astype("<i8"))), schema)

    return rows.mapInArrow(run, _PAGES.format(kind=rows.schema["id"].dataType.simpleString()))


def _places(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.int64)


def _count(sums: DataFrame, stripes: Stripes) -> DataFrame:
    """(stripe, packed): the places and counts of each stripe's matrix that are not 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, now = np.zeros(stripes.rows * stripes.a_size, np.int64), None

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(matrix)
            packed = _pack(np.diff(at, prepend=0).astype("<u4"), matrix[at].astype("<i8"))
            matrix[at] = 0
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([packed], pa.binary())], ["stripe", "packed"])

        for batch in batches:
            for stripe, packed in zip(batch.column("stripe").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if stripe != now:
                    if now is not None:
                        yield done()
                    now = stripe
                gaps, counts = _unpack(packed, "<u8", "<i8")
                np.add.at(matrix, _places(gaps), counts)
        if now is not None:
            yield done()

    return sums.select("stripe", "packed").repartition("stripe").sortWithinPartitions("stripe").mapInArrow(run, "stripe int, packed binary")


def _score(pages: DataFrame, matrices: DataFrame, stripes: Stripes, cell_bytes: int) -> DataFrame:
    """(page, packed): sums by document of the links that are best, and of the links' counts."""
    # One row for each stripe; their number depends on the vocabularies alone.
    cells = F.broadcast(pages.groupBy("stripe").agg(F.ceil(F.sum("bytes") / cell_bytes).cast("int").alias("cells")))
    of_pages = pages.join(cells, "stripe").select("stripe", F.pmod(F.hash("page"), F.col("cells")).alias("cell"), "page", "packed")
    copies = matrices.join(cells, "stripe").select("stripe", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(-1).cast("bigint").alias("page"), "packed")
    dealt = copies.unionByName(of_pages).repartition("stripe", "cell").sortWithinPartitions("stripe", "cell", "page")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, best, filled = np.zeros((stripes.rows, stripes.a_size), np.int64), None, np.empty(0, np.int64)
        sums: dict[int, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()), pa.array([_pack(x[0], x[1]) for x in sums.values()], pa.binary())], ["page", "packed"])
            sums.clear()
            return out

        for batch in batches:
            for page, packed in zip(batch.column("page").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if page < 0:
                    gaps, counts = _unpack(packed, "<u4", "<i8")
                    matrix.ravel()[filled] = 0
                    filled = _places(gaps)
                    matrix.ravel()[filled] = counts
                    best = matrix.max(1)
                    continue
                gaps, text, number = _unpack(packed, "<u4", "<u2", "<u4")
                at, text, number = _places(gaps), text.astype(np.int64), number.astype(np.int64)
                count = matrix.ravel()[at]
                held = sums.get(page)
                if held is None or held.shape[1] <= text.max():
                    wider = np.zeros((2, int(text.max()) + 1), np.int64)
                    if held is not None:
                        wider[:, : held.shape[1]] = held
                    held = sums[page] = wider
                np.add.at(held[0], text, np.where(count == best[at // stripes.a_size], number, 0))
                np.add.at(held[1], text, number * count)
                if len(sums) > 4096:
                    yield flush()
        if sums:
            yield flush()

    return dealt.select("page", "packed").mapInArrow(run, "page bigint, packed binary")


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", matrix_bytes: int = MATRIX_BYTES, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    a_path: byte-level BPE (tokenizers), given a space and the text; b_path: sentencepiece BPE, given the text.
    """
    spark = docs.sparkSession
    with open(a_path, "rb") as f:
        a_content = f.read()
    with open(b_path, "rb") as f:
        b_content = f.read()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), whole_text(f"`{text_col}`").alias("text"))
    stripes = Stripes(ByteLevelA(a_content).size, PiecesB(b_content).size, matrix_bytes)
    kind = rows.schema["id"].dataType.simpleString()
    with scratch(spark):
        pages = materialise(_tokenize(rows, a_content, b_content, matrix_bytes), "align-pages", keep=True)
        matrices = materialise(_count(pages.where(F.col("kind") == _PAIRS), stripes), "align-counts")
        links = pages.where(F.col("kind") == _LINKS).select("stripe", "page", "bytes", "packed")
        scores = materialise(_score(links, matrices, stripes, cell_bytes), "align-scores", keep=True)

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        texts, sums = None, []
        for row in (table.slice(i, 1).to_pylist()[0] for i in range(table.num_rows)):
            if row["packed"] is None:
                texts = row
            else:
                sums.append(_unpack(row["packed"], "<i8", "<i8"))
        totals = np.zeros((2, len(texts["ids"])), np.int64)
        for best, counts in sums:
            totals[0, : len(best)] += best
            totals[1, : len(counts)] += counts
        columns = [pa.array(texts["ids"], table.schema.field("ids").type.value_type), *[pa.array(texts[n], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]]
        return pa.Table.from_arrays([*columns, pa.array(totals[0]), pa.array(totals[1]), pa.array(texts["digests"], pa.string())], ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    texts = pages.where(F.col("kind") == _TEXTS).select("page", "packed", "ids", "n_a", "n_b", "n_groups", "n_links", "digests")
    out = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return texts.unionByName(scores, allowMissingColumns=True).groupBy("page").applyInArrow(finish, out).withColumnRenamed("id", id_col)
