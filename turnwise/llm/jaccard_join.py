"""Exact n-gram Jaccard join in a metric space, and the groups that its links form.

The distance 1 - J is a metric, and so is the number of shingles by which two sets differ,
also when only a part of all shingles is looked at. Two linked documents x and y differ by
few: y lacks at most `e` = size(x) - threshold * size(x) shingles of x.

A step of the join, inside one region (at first: everything):
1. Pivots. Every shingle that several members hold elects one of its holders, the one with
   the lowest row number. The elected are pivots, and each owns the part of the shingles that elected it.
2. Voronoi regions. A member's distance to a pivot is measured in the pivot's part: it shares
   c of those shingles. It lives with its nearest pivot, the one with the largest c; if that is
   `e` or less, also with the next nearest, until they hold more than `e` of its shingles
   together, so that no document linked with it can lack all of them.
3. Windows. By the triangle inequality in the pivot's part, a document linked with x shares at
   least c - e shingles of it. Members of other regions that share the least that any member
   living there asks, and whose size allows a link, are replicated across the border.
4. A region of at most CELL members is joined in one task: its pivot and then the members
   that live there are measured against those others that no measured distance to an earlier
   pivot rules out (|d(x, p) - d(y, p)| <= radius) and that no link connects with them yet.
5. In a larger region all members are measured against the pivot, over many tasks. Those in
   its ball are linked with it and need no comparison among themselves. The others are
   strangers; the region is cut by distance to the pivot into overlapping windows as wide as
   the radius, and each window with few strangers is joined in tiles (strangers against a
   block of members), while a window with many is the region of the next step, in which only
   strangers stand as pivots and have to find their links. Tiles take over where a step leaves
   half of those that ask as strangers of one window, and below DEEP steps. A task counts the
   shingles that its members share once for all of its pivots.
Each step is exact, so the links found connect what all links would connect.

Before the first step an exact filter leaves only documents that can link at all: a prefix of
each set, in hash order and a little longer than the threshold asks, is dealt by hash, and a
document must meet others in a stated share of its prefix. Those that do go through the same
filter again with a longer prefix (two fifths of the set, of which half must be met).

Equal sets are one node, so copies cost one row each. Links are emitted only between groups
that were apart, never all pairs of a region. No text or set goes to the driver. Shingles are
64-bit hashes, so the result is exact up to a chance of 2^-64 for each pair of shingles.

Defined results: null, empty and blank texts have 0 shingles and are linked with nothing.
Very long texts are read whole; one set travels as one value. Rows of equal id are separate
documents of that id, repeated rows too; ties of pivots are broken by row number. Any type
of id will do; a null id counts as the smallest, and a group of null ids alone has a null
component. An empty table gives an empty result. Only id and text are used, so other columns
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.llm.bitmaps import bitmap, with_hit
from turnwise.llm.components import connected
from turnwise.llm.shingles import set_print, shingle_sets
from turnwise.llm.text import text_slices, whole_text
from turnwise.session import materialise, scratch

WIDTH = 5
#: The threshold as a fraction of whole numbers: intersection * SIM[1] >= union * SIM[0].
SIM = (80, 100)
#: Entries of prefixes that one task sorts at a time.
ENTRIES = 1 << 20
#: The longer prefix asks one in so many of the entries that a linked set would share.
ASKED = 4
#: Row numbers of one partition share all bits above these; no place in a partition is NOBODY.
BLOCK_BITS = 31
NOBODY = (1 << 32) - 1
#: Members, and entries of their sets, of a region or tile that one task joins.
CELL = 1024
CELL_ENTRIES = 1 << 20
#: Steps after which windows with many strangers are joined in tiles.
DEEP = 5
#: Windows of up to so many tiles are joined in them at once.
TILES = 64
#: Numbers of a dense block in which a task counts shared shingles.
BLOCK = 1 << 22
#: So many distances to earlier pivots are kept for each task's region.
KEPT = 8


def _least(n: int, sim: tuple[int, int]) -> int:
    """Shingles that a set of size n shares with any set within the threshold, at least."""
    return -(-n * sim[0] // sim[1])


def _spare(n: int) -> int:
    """By so many entries is a prefix longer than one common entry would ask."""
    return n // 20


def _content_key(id_col: Column, text: Column) -> Column:
    """Finds a row's text again. Many rows of one id, null ids among them, have different keys, and so have copies of one text."""
    return F.xxhash64(F.coalesce(id_col.cast("string"), F.lit("")), text)


def _describe(docs: DataFrame, id_col: str, text_col: str, width: int, sim: tuple[int, int], row: Column) -> DataFrame:
    """(row, id, key, n, node, entries) of every row; node: the print of its set, entries: its prefix."""
    text = whole_text(text_col)
    rows = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("id"), _content_key(F.col(f"`{id_col}`"), text).alias("key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 2 << 20):
            sets = shingle_sets(batch.column("text"), width)
            prefixes = [s[: len(s) - _least(len(s), sim) + 1 + _spare(len(s))].tobytes() if len(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("key"), pa.array(map(len, sets), pa.int64()), pa.array(map(set_print, sets), pa.binary()), pa.array(prefixes, pa.binary())], ["row", "id", "key", "n", "node", "entries"])

    return rows.mapInArrow(run, f"row bigint, id {rows.schema['id'].dataType.simpleString()}, key bigint, n bigint, node binary, entries binary")


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal values."""
    start = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.empty(0, np.int64)
    return start, np.diff(np.append(start, len(sorted_values)))


def _met(described: DataFrame, ranges: int) -> DataFrame:
    """(row, met): how many of each row's entries other rows hold too, of described(row, entries); rows without any are left out.

    Entries travel in blocks, one for each range of hashes. A task first settles what repeats
    within its own rows and sends one entry for it, marked, so an entry that a third of all rows
    hold costs one row for each task. Rows are written as the place in their block of row
    numbers (monotonically_increasing_id numbers a partition's rows without gaps).
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(base: int, values: list[np.ndarray], rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            s, r = np.concatenate(values), np.concatenate(rows)
            order = np.argsort(s, kind="stable")
            s, r = s[order], r[order]
            start, length = _runs(s)
            many = length > 1
            own, times = np.unique(r[np.repeat(many, length)], return_counts=True)
            s, r = s[start], np.where(many, NOBODY, r[start])
            to = ((s * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            s, r, to = s[order], r[order], to[order]
            start, length = _runs(to)
            cut = [slice(a, a + n) for a, n in zip(start.tolist(), length.tolist(), strict=True)]
            keys = [*to[start].tolist(), *([-1 - int(own[0]) % ranges] if len(own) else [])]
            entries = [*[s[c].tobytes() for c in cut], *([times.astype(np.uint64).tobytes()] if len(own) else [])]
            holders = [*[r[c].tobytes() for c in cut], *([own.tobytes()] if len(own) else [])]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([base] * len(keys), pa.int64()), pa.array(entries, pa.binary()), pa.array(holders, pa.binary())], ["range", "base", "entries", "rows"])

        base, values, rows, held = 0, [], [], 0
        for batch in batches:
            for row, packed in zip(batch.column("row").to_pylist(), batch.column("entries"), strict=True):
                s = np.frombuffer(packed.as_buffer(), np.uint64)
                if not len(s):
                    continue
                if held and (row >> BLOCK_BITS << BLOCK_BITS != base or held >= 4 * ENTRIES):
                    yield from out(base, values, rows)
                    values, rows, held = [], [], 0
                base = row >> BLOCK_BITS << BLOCK_BITS
                values.append(s)
                rows.append(np.full(len(s), row - base, np.uint32))
                held += len(s)
        if held:
            yield from out(base, values, rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the rows that share entries, packed by blocks of rows."""

        def rows_of(base: int, packed: bytes) -> np.ndarray:
            r = np.frombuffer(packed, np.uint32).astype(np.int64)
            return np.where(r == NOBODY, -1, r + base)

        def shared(entries: list[bytes], rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            s, r = np.frombuffer(b"".join(entries), np.uint64), np.concatenate(rows)
            order = np.argsort(s, kind="stable")
            s, r = s[order], r[order]
            start, length = _runs(s)
            hit = r[np.repeat(length > 1, length)]
            return np.unique(hit[hit >= 0], return_counts=True)

        def out(hits: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            row, n = _summed(hits)
            to = (row >> 10) % blocks
            order = np.argsort(to, kind="stable")
            row, n, to = row[order], n[order], to[order]
            start, length = _runs(to)
            cut = [slice(a, a + k) for a, k in zip(start.tolist(), length.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(to[start]), pa.array([row[c].tobytes() for c in cut], pa.binary()), pa.array([n[c].tobytes() for c in cut], pa.binary())], ["block", "rows", "counts"])

        now, entries, rows, hits = None, [], [], []
        for batch in batches:
            for key, base, s, r in zip(*[batch.column(c).to_pylist() for c in ("range", "base", "entries", "rows")], strict=True):
                if key < 0:
                    hits.append((rows_of(base, r), np.frombuffer(s, np.uint64).astype(np.int64)))
                    continue
                if key != now and entries:
                    hits.append(shared(entries, rows))
                    entries, rows = [], []
                    if sum(len(h[0]) for h in hits) > 4 * ENTRIES:
                        yield out(hits)
                        hits = []
                now = key
                entries.append(s)
                rows.append(rows_of(base, r))
        if entries:
            hits.append(shared(entries, rows))
        if hits:
            yield out(hits)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(hits: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(hits)], ["row", "met"])

        now, hits = None, []
        for batch in batches:
            for block, rows, counts in zip(*[batch.column(c).to_pylist() for c in ("block", "rows", "counts")], strict=True):
                if block != now and hits:
                    yield out(hits)
                    hits = []
                now = block
                hits.append((np.frombuffer(rows, np.int64), np.frombuffer(counts, np.int64)))
        if hits:
            yield out(hits)

    blocks = max(1, ranges // 4)
    dealt = described.select("row", "entries").mapInArrow(deal, "range bigint, base bigint, entries binary, rows binary").repartition("range").sortWithinPartitions("range")
    met = dealt.mapInArrow(meet, "block bigint, rows binary, counts binary").repartition("block").sortWithinPartitions("block")
    return met.mapInArrow(total, "row bigint, met bigint")


def _summed(hits: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts added up by row."""
    rows, counts = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
    order = np.argsort(rows, kind="stable")
    start, _ = _runs(rows[order])
    return rows[order][start], np.add.reduceat(counts[order], start) if len(start) else counts


def _sets_of(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(rid, n, entries, at) of each node in reps(node, rid, key), from the texts; at numbers the rows of each partition without gaps."""
    text = whole_text(text_col)
    texts = docs.select(_content_key(F.col(f"`{id_col}`"), text).alias("key"), text.alias("text"))
    wanted = with_hit(texts, F.col("key"), bitmap(reps, F.col("key"))).where("hit").drop("hit")
    rows = wanted.join(reps, "key").select("rid", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 1 << 20, 256):
            sets = shingle_sets(batch.column("text"), width)
            same = [(rid, s) for rid, node, s in zip(batch.column("rid").to_pylist(), batch.column("node").to_pylist(), sets, strict=True) if set_print(s) == node]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in same], pa.int64()), pa.array([len(x[1]) for x in same], pa.int64()), pa.array([x[1].tobytes() for x in same], pa.binary())], ["rid", "n", "entries"])

    sets = rows.mapInArrow(run, "rid bigint, n bigint, entries binary")
    found = materialise(sets.withColumn("at", F.monotonically_increasing_id()), "join-sets")
    if found.count() == reps.count():
        return found
    # Fully repeated rows are found as often as they are repeated.
    return materialise(found.dropDuplicates(["rid"]).withColumn("at", F.monotonically_increasing_id()), "join-sets")


def _able(sets: DataFrame, sim: tuple[int, int]) -> DataFrame:
    """Those of sets(rid, n, entries, at) that meet others in `asked` entries of a longer prefix; a few more may pass, and every linked one does.

    With a prefix of n - least + asked entries, two linked sets share what the larger asks: the one
    whose prefix ends at the lower hash has least - asked entries behind it, and that number and
    `asked` both grow with n.
    """
    least = F.ceil(F.col("n") * sim[0] / sim[1])
    asked = F.greatest(F.lit(1), F.floor(least / ASKED))
    prefix = F.substring("entries", F.lit(1), (8 * (F.col("n") - least + asked)).cast("int"))
    entries = sets.select(F.col("at").alias("row"), prefix.alias("entries"))
    met = _met(entries, _ranges(entries)).join(sets.select(F.col("at").alias("row"), "rid", "n"), "row")
    kept = materialise(met.where(F.col("met") >= asked).select("rid"), "join-able")
    hit = with_hit(sets, F.xxhash64("rid"), bitmap(kept, F.xxhash64("rid"))).where("hit")
    return materialise(hit.select("rid", "n", "entries"), "join-able-sets", keep=True)


def _shingles(members: DataFrame) -> DataFrame:
    """(g, rid, n, core, s) for each shingle of members(g, rid, n, core, entries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "entries"):
            n = batch.column("n").to_numpy()
            keys = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n)) for c in ("g", "rid", "n", "core")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.frombuffer(b"".join(batch.column("entries").to_pylist()), np.int64))], ["g", "rid", "n", "core", "s"])

    return members.select("g", "rid", "n", "core", "entries").mapInArrow(run, "g bigint, rid bigint, n bigint, core boolean, s bigint")


def _shared_ok(shared: Column, a: Column, b: Column, sim: tuple[int, int]) -> Column:
    """Whether sets of sizes a and b with so many shared shingles are within the threshold."""
    return shared * sim[1] >= (a + b - shared) * sim[0]


def _regions(members: DataFrame, depth: int, sim: tuple[int, int]) -> DataFrame:
    """(g, pivot, rid, n, core, own) of the regions within each region of members(g, rid, n, core, own, entries).

    core: the member lives there and has to find its links; the others are border documents.
    """
    held = _shingles(members)
    stood = held.groupBy("g", "s").agg(F.count("*").alias("holders"), F.min(F.when(F.col("core"), F.col("rid"))).alias("pivot")).where("holders > 1 AND pivot IS NOT NULL")
    live = held.join(stood.select("g", "s", "pivot"), ["g", "s"])
    counts = live.groupBy("g", "rid", "n", "core", "pivot").agg(F.count("*").alias("c"))
    nearest = Window.partitionBy("g", "rid").orderBy(F.col("c").desc(), "pivot")
    least = F.ceil(F.col("n") * sim[0] / sim[1])
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(nearest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("live", F.sum("c").over(Window.partitionBy("g", "rid")))
    counts = counts.where(F.col("live") >= least).withColumn("lives", F.col("core") & (F.col("before") <= F.col("n") - least))
    counts = materialise(counts.select("g", "pivot", "rid", "n", "c", "lives"), "join-counts")
    asks = F.greatest(F.lit(1), F.col("c") - (F.col("n") - least))
    homes = counts.where("lives").groupBy("g", "pivot").agg(F.min(asks).alias("asked"), F.min("n").alias("smallest"), F.max("n").alias("largest"))
    sized = (F.col("n") * sim[1] >= F.col("smallest") * sim[0]) & (F.col("n") * sim[0] <= F.col("largest") * sim[1])
    near = counts.join(homes, ["g", "pivot"]).where(F.col("lives") | ((F.col("c") >= F.col("asked")) & sized))
    return near.select(F.xxhash64("g", "pivot", F.lit(depth)).alias("g"), "pivot", "rid", "n", F.col("lives").alias("core"))


def _ball(region: DataFrame, sets: DataFrame, sim: tuple[int, int]) -> DataFrame:
    """Adds shared, the shingles shared with the pivot, to region(g, pivot, rid, ..., tasks, entries); the pivot's set is copied to as many salts as the region has tasks."""
    salts = F.greatest(F.lit(1), F.col("tasks")).cast("int")
    dealt = region.withColumn("salt", F.pmod(F.xxhash64("rid"), salts).cast("int"))
    pivots = region.select("g", "pivot", "tasks").distinct().join(sets.select(F.col("rid").alias("pivot"), F.col("n").alias("p_n"), F.col("entries").alias("p_entries")), "pivot")
    pivots = pivots.select("g", "p_n", "p_entries", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "entries"):
            shared = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in zip(batch.column("entries").to_pylist(), batch.column("p_entries").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("g", "pivot", "rid", "n", "p_n", "core", "own", "asking")], pa.array(shared, pa.int64())], ["g", "pivot", "rid", "n", "p_n", "core", "own", "asking", "shared"])

    return dealt.join(pivots, ["g", "salt"]).select("g", "pivot", "rid", "n", "p_n", "core", "own", "asking", "entries", "p_entries").mapInArrow(run, "g bigint, pivot bigint, rid bigint, n bigint, p_n bigint, core boolean, own bigint, asking bigint, shared bigint")


def _windows(measured: DataFrame, sim: tuple[int, int]) -> DataFrame:
    """(g, rid, n, core, own, asking) of overlapping windows of distance to the pivot, for measured(..., near)."""
    radius = 1 - sim[0] / sim[1]
    away = 1 - F.col("shared") / (F.col("n") + F.col("p_n") - F.col("shared"))
    # A hair wider than the radius, so that rounding loses nothing.
    band = F.floor(away / (radius * 1.0000001)).cast("int")
    strange = F.col("core") & ~F.col("near")
    cut = measured.select(F.explode(F.array(band, band + 1)).alias("window"), "g", "rid", "n", strange.alias("core"), F.when(F.col("near"), F.col("pivot")).otherwise(F.col("own")).alias("own"), "asking")
    return cut.select(F.xxhash64("g", "window").alias("g"), "rid", "n", "core", "own", "asking")


def shared_counts(asking: np.ndarray, sizes: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """How many entries each asking set shares with each set; `whole` holds the sets one after another.

    Entries that many sets hold are columns of a dense product, those of few are counted pair by pair.
    """
    k = len(sizes)
    _, entry, holders = np.unique(whole, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(k), sizes)
    out = np.zeros((len(asking), k), np.int64)
    place = np.full(k, -1)
    place[asking] = np.arange(len(asking))
    heavy = holders > max(1, k // 16)
    column = np.cumsum(heavy) - 1
    dense = np.flatnonzero(heavy[entry])
    dense = dense[np.argsort(column[entry[dense]], kind="stable")]
    at, rows = column[entry[dense]], owner[dense]
    wide = max(1, BLOCK // k)
    for a in range(0, int(heavy.sum()), wide):
        part = slice(*np.searchsorted(at, [a, a + wide]))
        block = np.zeros((k, min(wide, int(heavy.sum()) - a)), np.float32)
        block[rows[part], at[part] - a] = 1
        out += (block[asking] @ block.T).astype(np.int64)
    few = np.flatnonzero(((holders > 1) & ~heavy)[entry])
    few = few[np.argsort(entry[few], kind="stable")]
    value, rows = entry[few], owner[few]
    for step in range(1, int(holders[~heavy].max(initial=1))):
        same = np.flatnonzero(value[step:] == value[:-step])
        for a, b in ((rows[same], rows[same + step]), (rows[same + step], rows[same])):
            asks = place[a] >= 0
            np.add.at(out.reshape(-1), place[a[asks]] * k + b[asks], 1)
    # A set shares all its entries with itself.
    out[np.arange(len(asking)), asking] = sizes[asking]
    return out


def join_region(rids: np.ndarray, sizes: np.ndarray, core: np.ndarray, own: np.ndarray, sets: list[np.ndarray], pivot: int, sim: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between the groups of one region: every core member meets all others that could link with it and are not yet connected with it.

    `own` names groups that are connected beforehand. Each member that has met the others is a
    pivot for the rest: what is farther from or nearer to it by more than the radius cannot link.
    """
    k = len(rids)
    group = np.unique(own, return_inverse=True)[1]
    met = np.zeros(k, bool)
    radius = (1 - sim[0] / sim[1]) * 1.0000001
    away: list[np.ndarray] = []
    links = []
    order = np.flatnonzero(core)
    first = np.flatnonzero(rids == pivot)[:1]
    turns = np.append(first, order[order != (first[0] if len(first) else -1)])
    counts = shared_counts(turns, sizes, np.concatenate(sets)) if k else np.empty((0, 0), np.int64)
    for turn, i in enumerate(turns.tolist()):
        ask = group != group[i]
        if turn or k < 8:
            ask &= ~met & (sizes * sim[1] >= sizes[i] * sim[0]) & (sizes * sim[0] <= sizes[i] * sim[1])
            for v in away:
                ask &= ~(np.abs(v - v[i]) > radius)
        met[i] = True
        to = np.flatnonzero(ask)
        if not len(to):
            continue
        shared = counts[turn, to]
        union = sizes[i] + sizes[to] - shared
        if len(away) < KEPT:
            away.append(1 - counts[turn] / (sizes[i] + sizes - counts[turn]))
        near = to[shared * sim[1] >= union * sim[0]]
        for j in near[np.unique(group[near], return_index=True)[1]].tolist():
            links.append((int(rids[i]), int(rids[j])))
            group[group == group[j]] = group[i]
    return links


def _join_tasks(dealt: DataFrame, sim: tuple[int, int]) -> DataFrame:
    """(a, b) links of dealt(task, pivot, rid, n, core, own, entries): each task's rows are one region or tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def join(rows: list[tuple]) -> list[tuple[int, int]]:
            pivots, rids, sizes, core, own, sets = zip(*rows, strict=True)
            return join_region(np.array(rids), np.array(sizes), np.array(core), np.array(own), [np.frombuffer(x, np.uint64) for x in sets], pivots[0], sim)

        now, rows = None, []
        links: list[tuple[int, int]] = []
        for batch in batches:
            for task, *row in zip(*[batch.column(c).to_pylist() for c in ("task", "pivot", "rid", "n", "core", "own", "entries")], strict=True):
                if task != now and rows:
                    links += join(rows)
                    rows = []
                now = task
                rows.append(row)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])
                links = []
        if rows:
            links += join(rows)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    return dealt.select("task", "pivot", "rid", "n", "core", "own", "entries").repartition("task").sortWithinPartitions("task", "rid").mapInArrow(run, "a bigint, b bigint")


def _tasks(count: str, entries: str, cell: int, cell_entries: int) -> Column:
    return F.ceil(F.greatest(F.col(count) / cell, F.col(entries) / cell_entries)).cast("int")


def _ranges(described: DataFrame) -> int:
    """Ranges of hashes, each of about ENTRIES entries, and several for each partition."""
    entries = described.agg(F.coalesce(F.sum(F.length("entries")), F.lit(0))).first()[0] // 8
    return max(4 * int(described.sparkSession.conf.get("spark.sql.shuffle.partitions")), entries // ENTRIES)


def links_of(sets: DataFrame, sim: tuple[int, int] = SIM, cell: int = CELL, cell_entries: int = CELL_ENTRIES, deep: int = DEEP, tiles: int = TILES) -> DataFrame:
    """(a, b) links between rows of sets(rid, n, entries) that connect whatever all links connect."""
    members = sets.select(F.lit(0).cast("bigint").alias("g"), "rid", "n", F.lit(True).alias("core"), F.col("rid").alias("own"), "entries")
    found: list[DataFrame] = []
    depth = 0
    while True:
        regions = _regions(members, depth, sim)
        if depth:
            # `own` stays with the member inside the region that it comes from.
            own = members.groupBy("rid").agg(F.min("own").alias("own"))
            regions = regions.join(own, "rid")
        else:
            regions = regions.withColumn("own", F.col("rid"))
        regions = materialise(regions, "join-regions")
        sizes = regions.groupBy("g").agg(F.count("*").alias("k"), F.sum("n").alias("size"), F.count_if("core").alias("asking")).where("k > 1 AND asking > 0")
        sizes = sizes.withColumn("tasks", _tasks("k", "size", cell, cell_entries))
        peopled = materialise(regions.join(sizes, "g"), "join-peopled")
        wanted = with_hit(sets.select("rid", "entries"), F.xxhash64("rid"), bitmap(peopled, F.xxhash64("rid"))).where("hit").drop("hit")
        sized = materialise(peopled.join(wanted, "rid"), "join-sized")
        small = sized.where("tasks = 1").withColumn("task", F.col("g"))
        found.append(materialise(_join_tasks(small, sim), "join-links"))
        large = sized.where("tasks > 1")
        if large.isEmpty():
            break
        near = _shared_ok(F.col("shared"), F.col("n"), F.col("p_n"), sim)
        measured = materialise(_ball(large, sets, sim).withColumn("near", near), "join-measured")
        found.append(measured.where("near AND rid <> pivot").select(F.col("pivot").alias("a"), F.col("rid").alias("b")))
        windows = _windows(measured, sim)
        stats = windows.groupBy("g").agg(F.count("*").alias("k"), F.sum("n").alias("size"), F.count_if("core").alias("strangers"), F.sum(F.when(F.col("core"), F.col("n"))).alias("strange"), F.max("asking").alias("asking")).where("strangers > 0 AND k > 1")
        windows = materialise(windows.drop("asking").join(stats, "g").join(sets.select("rid", "entries"), "rid"), "join-windows")
        rows, columns = _tasks("strangers", "strange", cell, cell_entries), _tasks("k", "size", cell, cell_entries)
        # Where one window keeps half of those that asked, the next step would copy them into more windows without parting them.
        few = F.lit(depth + 1 >= deep) | (rows <= 1) | (rows * columns <= tiles) | (F.col("strangers") * 2 > F.col("asking"))
        tiled = windows.where(few).withColumn("rows", rows).withColumn("columns", columns).withColumn("h", F.xxhash64("rid", F.lit(-1)))
        # Tile (i, j): strangers of row i, asking, and members of column j.
        asking = tiled.where("core").select("g", "rid", "n", "core", "own", "entries", F.pmod("h", F.col("rows")).alias("i"), F.explode(F.expr("sequence(0, columns - 1)")).alias("j"))
        asked = tiled.select("g", "rid", "n", F.lit(False).alias("core"), "own", "entries", F.explode(F.expr("sequence(0, rows - 1)")).alias("i"), F.pmod(F.shiftright("h", 20), F.col("columns")).alias("j"))
        dealt = asking.unionByName(asked).withColumn("task", F.xxhash64("g", "i", "j")).withColumn("pivot", F.lit(-1).cast("bigint"))
        found.append(materialise(_join_tasks(dealt, sim), "join-links"))
        members = windows.where(~few).select("g", "rid", "n", "core", "own", "entries")
        if members.isEmpty():
            break
        depth += 1
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def candidates(described: DataFrame, sim: tuple[int, int]) -> DataFrame:
    """(node, rid, key): nodes that meet others in their prefixes, each with a row that stands for it (rows of one node have equal sets)."""
    met = _met(described, _ranges(described)).join(described.select("row", "key", "n", "node"), "row")
    asked = 1 + F.floor(F.ceil(F.col("n") * sim[0] / sim[1]) / 20)
    reps = met.where(F.col("met") >= asked).groupBy("node").agg(F.min(F.struct("row", "key")).alias("one"))
    return materialise(reps.select("node", F.col("one.row").alias("rid"), F.col("one.key").alias("key")), "join-reps", keep=True)


def linked(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, width: int, sim: tuple[int, int]) -> DataFrame:
    """(node, label): nodes of reps(node, rid, key) that have links; equal labels for those that links connect."""
    with scratch(docs.sparkSession):
        sets = _able(_sets_of(docs, reps, id_col, text_col, width), sim)
    links = materialise(links_of(sets, sim).where("a <> b").distinct(), "join-links")
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = connected(ends.withColumn("label", F.col("node")), links)
    return reps.join(labels.toDF("rid", "label"), "rid").select("node", "label")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, sim: tuple[int, int]) -> DataFrame:
    """(id, key, n, component, first) of every row; first: of the group's rows the one with the smallest id and row."""
    with scratch(docs.sparkSession):  # the prefixes go as soon as the candidates are known
        with_prefix = materialise(_describe(docs, id_col, text_col, width, sim, F.monotonically_increasing_id()), "join-prefixes")
        described = materialise(with_prefix.drop("entries"), "join-described", keep=True)
        reps = candidates(with_prefix, sim)
    lowest = described.where("n > 0").groupBy("node").agg(F.min(F.struct("id", "row")).alias("low"), F.count("*").alias("rows"))
    merged = materialise(lowest.join(linked(docs, reps, id_col, text_col, width, sim), "node").select("node", "label", "low"), "join-merged")
    least = materialise(merged.groupBy("label").agg(F.min("low").alias("least")), "join-least")
    merged = merged.join(least, "label").select("node", "least")
    lowest = lowest.join(merged, "node", "left").where("least IS NOT NULL OR rows > 1").select("node", F.coalesce("least", "low").alias("low"))
    lowest = materialise(lowest, "join-lowest")
    out = described.join(lowest, "node", "left")
    alone = F.when(F.col("low").isNull(), F.col("id")).otherwise(F.col("low.id"))
    return out.select("id", "key", "n", alone.alias("component"), (F.col("low").isNull() | (F.col("row") == F.col("low.row"))).alias("first"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, sim: tuple[int, int] = SIM) -> DataFrame:
    """id, n_shingles and component_id (the smallest id that links reach) of every row."""
    with scratch(docs.sparkSession):
        out = _grouped(docs, id_col, text_col, width, sim)
        return materialise(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")), "join-result", keep=True)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, sim: tuple[int, int] = SIM) -> DataFrame:
    """One row of each group, with the smallest id; all columns are kept. Of rows with equal id and text that differ in other columns any one stays; documents without words all stay."""
    with scratch(docs.sparkSession):
        decided = _grouped(docs, id_col, text_col, width, sim).where("n > 0").groupBy("id", "key").agg(F.max("first").alias("stays"), F.count("*").alias("times"))
        marks = materialise(decided.where("times > 1 OR NOT stays").toDF("of_id", "of_key", "stays", "times"), "join-marks", keep=True)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(whole, F.col(f"`{id_col}`").alias("id"), _content_key(F.col(f"`{id_col}`"), whole_text(text_col)).alias("key"))
    rows = with_hit(rows, F.xxhash64("id", "key"), bitmap(marks, F.xxhash64("of_id", "of_key")))
    is_marked = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key"))
    judged = rows.where("hit").join(marks, is_marked, "left")
    # Rows with equal id and text: one of them stays.
    repeated = judged.where("stays").groupBy("id", "key").agg(F.first("doc").alias("doc"))
    return rows.where("NOT hit").select("doc").unionByName(judged.where("stays IS NULL").select("doc")).unionByName(repeated.select("doc")).select("doc.*")
