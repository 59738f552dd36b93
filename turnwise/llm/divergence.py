"""Audit of how far the sources of a language diverge, by a systolic rotation of term vectors.

Each task counts the terms of its texts per (lang, source) before anything is shuffled; a
language keeps the terms of enough documents. Its vocabulary is cut into stripes of about
`STRIPE` terms by hash, and its sources into blocks. A cell (lang, stripe, block) holds the
block's sparse count vectors, compressed, and stays in its partition. In each round of a
round-robin tournament half of the blocks travel: one join on the cell brings every
resident its opponent, and a meeting gives the distance of each pair of sources in both
directions. In the home round a cell meets itself and its language's own vector, and a heap
for each source keeps the leading terms of the stripe. Distances are summed over stripes, and
the heaps' terms are ranked once more; the first ranks of all are among those of the stripes.

Memory of a task: a cell has at most `BLOCK` vectors of a stripe, whatever the number of
documents, terms and sources. Each vector is sent once a round.

All arithmetic is in integers; it is exact while a source's terms and five for each kept one
number less than 9 * 10^15.

Defined results: null text, lang and source count as ''. A repeated row, also one with the
same id, is one more document. Texts without terms, empty and null ones leave their group in
the result with counts of 0. A language that keeps no term has pairs of value 0 and no terms;
one with a single source has no pairs. Equal values rank by item in UTF-8 order. Very long
texts are counted whole. An empty table gives an empty result. Only text, lang and source are
used, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.llm.text import text_slices
from turnwise.session import materialise, scratch

#: Terms of a stripe, on average.
STRIPE = 4_096
#: Sources of a block at most; a language has SEATS blocks while that keeps blocks smaller.
BLOCK, SEATS = 64, 8
#: (source, term) counts that a task holds before it sends them on.
HELD = 400_000
#: Rounds that one job plays.
ROUNDS_A_JOB = 4
#: Steps of the long division, three decimals each.
STEPS = 3

#: Bytes that belong to no term become spaces, A-Z become a-z.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order: runs of ASCII letters and other characters beyond ASCII."""
    return text.translate(_TERM_BYTES).split()


def shares(counts: np.ndarray, mass: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / mass), exact; long division by a thousand at a time stays within 64 bits."""
    whole, rest = np.divmod(counts + 5, mass)
    for _ in range(STEPS):
        digit, rest = np.divmod(rest * 1000, mass)
        whole = whole * 1000 + digit
    return whole + 1


def pack_vector(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A sparse vector, its ids ascending: gaps and counts, compressed."""
    gaps = np.diff(ids, prepend=0).astype("<u4")
    return zstandard.ZstdCompressor(level=3).compress(gaps.tobytes() + counts.astype("<i8").tobytes())


def unpack_vector(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64), np.frombuffer(raw, "<i8", n, 4 * n)


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed inside each task."""

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            found = pa.array(list(n), pa.binary()).cast(pa.string())
            same = lambda x, k=len(n): pa.repeat(pa.scalar(x, pa.string()), k)
            yield pa.RecordBatch.from_arrays([same(lang), same(source), found, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in text_slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
                if found := terms(text):
                    n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                    n.update(found)
                    docs.update(set(found))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from flush(held)
        yield from flush(held)

    return rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def _cells(entries: DataFrame) -> DataFrame:
    """One row for each cell: its sources with their masses and packed vectors. Rows without an id stand for sources that may lack terms here."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("source", "ascending"), ("id", "ascending")])
        source = np.array(table.column("source").to_pylist(), object)
        starts = np.flatnonzero(np.append(True, source[1:] != source[:-1]))
        ids = table.column("id").fill_null(-1).to_numpy()
        n, mass = table.column("n").to_numpy(), table.column("mass").to_numpy()
        vectors = []
        for lo, hi in zip(starts, np.append(starts[1:], len(source)), strict=True):
            here = ids[lo:hi] >= 0
            vectors.append(pack_vector(ids[lo:hi][here], n[lo:hi][here]))
        columns = {"lang": [key[0].as_py()], "stripe": [key[1].as_py()], "block": [key[2].as_py()], "width": [table.column("width")[0].as_py()], "blocks": [table.column("blocks")[0].as_py()]}
        columns |= {"sources": [source[starts].tolist()], "masses": [mass[starts].tolist()], "vectors": [vectors]}
        return pa.table(columns, _CELL_ARROW)

    return entries.groupBy("lang", "stripe", "block").applyInArrow(pack, _CELL)


_CELL = "lang string, stripe int, block int, width int, blocks int, sources array<string>, masses array<bigint>, vectors array<binary>"
_CELL_ARROW = pa.schema([("lang", pa.string()), ("stripe", pa.int32()), ("block", pa.int32()), ("width", pa.int32()), ("blocks", pa.int32()), ("sources", pa.list_(pa.string())), ("masses", pa.list_(pa.int64())), ("vectors", pa.list_(pa.binary()))])


def partner(block: Column, blocks: Column, turn: int) -> Column:
    """The opponent of a block in a turn of the circle method; `blocks` or more: none. With n seats, an even number, there are n - 1 turns."""
    ring = blocks + blocks % 2 - 1  # the last seat stands still, all others move around it
    across = F.pmod(F.lit(turn) - block, ring)
    return F.when(block == ring, F.pmod(turn * F.floor((ring + 1) / 2), ring)).when(across == block, ring).otherwise(across).cast("int")


def _dense(vectors: list[bytes], masses: list[int], width: int) -> list[np.ndarray]:
    out = []
    for packed, mass in zip(vectors, masses, strict=True):
        ids, counts = unpack_vector(packed)
        full = np.full(width, shares(np.zeros(1, np.int64), mass)[0] if width else 0)
        full[ids] = shares(counts, mass)
        out.append(full)
    return out


_MEETING = "lang string, source string, part string, item string, value bigint"


def _rows(lang: str, found: list[tuple[str, str, str, int]]) -> pa.RecordBatch:
    source, part, item, value = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(found)), pa.array(source, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])


def _both_ways(a: str, b: str, value: int) -> tuple:
    return (a, "pair", b, value), (b, "pair", a, value)


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Resident and visiting block: the distance of every pair of sources in the stripe."""
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            guests = _dense(row["vectors2"], row["masses2"], row["width"])
            found: list = []
            for a, mine in zip(row["sources"], _dense(row["vectors"], row["masses"], row["width"]), strict=True):
                for b, other in zip(row["sources2"], guests, strict=True):
                    found += _both_ways(a, b, int(np.abs(mine - other).sum()))
            yield _rows(row["lang"], found)


def _home(limit: int):
    """A block by itself: pairs within it, and a heap of each source's leading terms against the language."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                whole = shares(np.array(row["lang_counts"], np.int64), row["lang_mass"]) if row["width"] else np.empty(0, np.int64)
                own = _dense(row["vectors"], row["masses"], row["width"])
                found: list = []
                for i, (a, mine) in enumerate(zip(row["sources"], own, strict=True)):
                    for b, other in zip(row["sources"][:i], own, strict=False):
                        found += _both_ways(a, b, int(np.abs(mine - other).sum()))
                    ids, _ = unpack_vector(row["vectors"][i])
                    ids = ids[mine[ids] > whole[ids]]
                    # Ids follow the order of the terms, so ties fall as they must.
                    lead = heapq.nsmallest(limit, zip((whole[ids] - mine[ids]).tolist(), ids.tolist(), strict=True))
                    found += [(a, "term", row["terms"][k], -v) for v, k in lead]
                yield _rows(row["lang"], found)

    return run


def source_divergence(docs: DataFrame, least_docs: int = 30, limit: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", stripe: int = STRIPE, block: int = BLOCK, seats: int = SEATS) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` has each other source of the language, `term` the leading terms.

    least_docs: documents of a language that a kept term is in; limit: ranks of `term`.
    """
    spark = docs.sparkSession
    named = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit(""))
    rows = docs.select(named(lang_col).alias("lang"), named(source_col).alias("source"), named(text_col).alias("text"))
    with scratch(spark):
        seen = Window.partitionBy("lang", "term")
        counted = _counted(rows).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        kept = materialise(counted.withColumn("docs", F.sum("docs").over(seen)).where(F.col("docs") >= least_docs).select("lang", "source", "term", "n"), "divergence-kept")
        vocab = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"))
        sizes = materialise(vocab.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n")), "divergence-sizes")
        stripes = F.ceil(F.col("v") / stripe).cast("int")
        placed = vocab.join(sizes.select("lang", stripes.alias("stripes")), "lang").withColumn("stripe", F.pmod(F.xxhash64("term"), F.col("stripes")).cast("int"))
        placed = placed.withColumn("id", F.row_number().over(Window.partitionBy("lang", "stripe").orderBy("term")) - 1)
        placed = materialise(placed.select("lang", "term", "n", "stripe", "id"), "divergence-terms")

        # One row for each group: languages have as many rows as sources, and pairs of them are the result.
        totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
        groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes.select("lang", "v"), "lang", "left")
        per = Window.partitionBy("lang")
        size = F.least(F.ceil(F.count("*").over(per) / seats), F.lit(block))
        groups = groups.select("lang", "source", (F.coalesce("n", F.lit(0)) + 5 * F.coalesce("v", F.lit(0))).alias("mass"), F.greatest(F.coalesce(stripes, F.lit(1)), F.lit(1)).alias("stripes"), F.floor((F.row_number().over(per.orderBy("source")) - 1) / size).cast("int").alias("block"), F.ceil(F.count("*").over(per) / size).cast("int").alias("blocks"))
        groups = materialise(groups, "divergence-groups")

        widths = placed.groupBy("lang", "stripe").agg(F.count("*").cast("int").alias("width"))
        seats_of = groups.select("*", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe")).join(widths, ["lang", "stripe"], "left").withColumn("width", F.coalesce("width", F.lit(0)))
        own = kept.join(placed.select("lang", "term", "stripe", "id"), ["lang", "term"]).select("lang", "source", "stripe", "id", "n")
        columns = ["lang", "stripe", "block", "source", "mass", "width", "blocks", "id", "n"]
        entries = seats_of.join(own, ["lang", "source", "stripe"], "left").select(*columns[:-1], F.coalesce("n", F.lit(0)).alias("n"))
        cells = materialise(_cells(entries), "divergence-cells")

        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        residents = cells.repartition(parts, "lang", "stripe", "block").persist()
        mass = sizes.select("lang", (F.col("n") + 5 * F.col("v")).alias("lang_mass"))
        listed = placed.groupBy("lang", "stripe").agg(F.sort_array(F.collect_list(F.struct("id", "term", "n"))).alias("x")).select("lang", "stripe", F.col("x.term").alias("terms"), F.col("x.n").alias("lang_counts")).join(mass, "lang")
        at_home = cells.select("lang", "stripe", "block").join(listed, ["lang", "stripe"], "left")
        played = [materialise(residents.join(at_home, ["lang", "stripe", "block"]).mapInArrow(_home(limit), _MEETING), "divergence-home")]
        most = groups.agg(F.max("blocks")).first()[0] or 0
        turns = most + most % 2 - 1 if most > 1 else 0  # with an odd number of blocks one rests in each turn
        for first in range(0, turns, ROUNDS_A_JOB):
            meetings = []
            for turn in range(first, min(first + ROUNDS_A_JOB, turns)):
                other = partner(F.col("block"), F.col("blocks"), turn)
                travels = (other < F.col("blocks")) & (turn < F.col("blocks") + F.col("blocks") % 2 - 1) & (((F.col("block") + other) % 2 == 0) == (F.col("block") < other))
                guests = cells.where(travels).select("lang", "stripe", other.alias("block"), F.col("sources").alias("sources2"), F.col("masses").alias("masses2"), F.col("vectors").alias("vectors2"))
                meetings.append(residents.join(guests, ["lang", "stripe", "block"]).mapInArrow(_meet, _MEETING))
            played.append(materialise(reduce(DataFrame.union, meetings), "divergence-round"))
        found = materialise(reduce(DataFrame.union, played).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "divergence", keep=True)
        residents.unpersist()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= limit)).select("lang", "source", "part", "item", "value", "rank")
