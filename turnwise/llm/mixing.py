"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Each source's documents are put in the order of a hash and their words laid end to end; that
stream is cut into blocks of equal size. The mix is a schedule of slots: slot t's point is
the t-th of the golden-ratio sequence, which falls into the source whose stretch of the
cumulative targets holds it. A source's slots are ranked, and the slot of rank r takes block
r of the source, from the start again after its last block, at most twice in all. A
document's words taken are the words that it shares with taken blocks.

Ranks and running sums are made in two levels (inside chunks of slots or hash buckets, then
over chunks), so a source that holds a third of all rows is spread over many tasks. Points
meet sources by an equi-join on cells of the unit interval, never by a range scan of all
sources. Only (id, source, size) travels.

Targets: source i of weight w_i and size S_i gets min(w_i * x, cap * S_i), with x such that
the targets add up to `share` of all words; that is the outcome of capping and resharing the
excess by weight until no target is above its cap.

Defined results: null text has size 0; a document without words is taken 0 times; a source
without words has target 0. The null source is a source, the last. Repeated rows are
documents of their own. An empty table gives an empty result. Only id, text and source are
used, so other columns cannot clash. Reruns agree, as order comes from a hash of the id; of
rows with equal id and size in a source, any may come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.llm.text import WORD
from turnwise.session import materialise, scratch

#: The golden ratio's fraction in 31 bits, made odd; cells of the unit interval; slots in a chunk.
POINTS = 1 << 31
STEP = 1327217885
CELLS = 4096
CHUNK = 1 << 16

BLOCK_WORDS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """(source, source_size, weight, target, nth) of sizes(source, size): one row per source, so a window over all of them is small."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    wheel = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    per = per.withColumn("nth", F.row_number().over(by_name) - 1).withColumn("weight", wheel)
    everyone = Window.partitionBy()
    tight = Window.orderBy(F.col("source_size") * cap / F.col("weight"), "nth")
    filled = F.coalesce(F.sum(F.col("source_size") * cap).over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(tight.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everyone) * share[0] / share[1] - filled) / rest
    per = per.withColumn("level", level).withColumn("open", F.col("source_size") * cap / F.col("weight") > F.col("level"))
    x = F.min(F.when(F.col("open"), F.struct(F.col("source_size") * cap / F.col("weight"), F.col("nth"), F.col("level")))).over(everyone)["level"]
    target = F.least(F.coalesce(F.col("weight") * x, F.lit(0.0)), (F.col("source_size") * cap).cast("double"))
    return per.select("source", "source_size", "weight", "nth", target.alias("target"))


def _key(id_col: str, text_col: str, source_col: str) -> Column:
    """Finds a row again, with its id: rows of one id, null ids among them, have different keys unless text and source are equal too."""
    return F.xxhash64(F.col(f"`{source_col}`"), F.col(f"`{text_col}`"), F.col(f"`{source_col}`").isNull())


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    with scratch(docs.sparkSession):
        out = _taken(docs, weights, share, cap, block_words, id_col, text_col, source_col)
        return materialise(out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken"), "mix-result", keep=True)


def _taken(docs: DataFrame, weights: tuple[int, ...], share: tuple[int, int], cap: int, block_words: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, id, key, size, source_size, target, taken) of every row."""
    spark = docs.sparkSession
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), _key(id_col, text_col, source_col).alias("key"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    sized = materialise(read.withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))), "mix-sizes")
    sources = materialise(source_targets(sized, weights, share, cap), "mix-sources")
    whole = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    slots = -(-whole * share[0] // (share[1] * block_words))

    # Slots to sources: every source's stretch of the points, cut into cells.
    ends = F.sum("target").over(Window.orderBy("nth")) / F.sum("target").over(Window.partitionBy())
    stretch = sources.where("target > 0").withColumn("hi", F.floor(ends * POINTS)).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("nth")), F.lit(0)))
    width = POINTS // CELLS
    stretch = stretch.where("hi > lo").select("nth", "lo", "hi", F.ceil(F.col("source_size") / block_words).alias("blocks"), F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("t"), (F.col("id") % POINTS * STEP % POINTS).alias("x")).withColumn("cell", F.expr(f"x div {width}"))
    dealt = points.join(stretch, "cell").where("x >= lo AND x < hi").select("nth", "t", "blocks", F.expr(f"t div {CHUNK}").alias("chunk"))

    # Ranks: inside chunks, then over the chunks before.
    counts = dealt.groupBy("nth", "chunk").agg(F.count("*").alias("n"))
    base = counts.select("nth", "chunk", (F.sum("n").over(Window.partitionBy("nth").orderBy("chunk")) - F.col("n")).alias("base"))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("nth", "chunk").orderBy("t")) - 1).join(base, ["nth", "chunk"])
    ranked = ranked.select("nth", "blocks", (F.col("base") + F.col("r")).alias("rank")).where(F.col("rank") < F.col("blocks") * cap)
    takes = ranked.groupBy("nth", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("times"))

    # Documents to blocks: inside hash buckets, then over the buckets before.
    known = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select("row", "id", "key", "size", "h", F.substring("h", 1, 3).alias("bucket"), "nth", "source_size", "target")
    totals = known.groupBy("nth", "bucket").agg(F.sum("size").alias("n"))
    base = totals.select("nth", "bucket", (F.sum("n").over(Window.partitionBy("nth").orderBy("bucket")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("nth", "bucket").orderBy("h", "id", "size", "row")
    placed = known.withColumn("run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).join(base, ["nth", "bucket"]).withColumn("a", F.col("base") + F.col("run"))
    spans = F.when(F.col("size") > 0, F.expr(f"sequence(a div {block_words}, (a + size - 1) div {block_words})"))
    pieces = placed.select("row", "id", "key", "size", "nth", "source_size", "target", "a", F.explode_outer(spans).alias("block"))
    shared = F.least(F.col("a") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("a"), F.col("block") * block_words)
    met = pieces.join(takes, ["nth", "block"], "left").withColumn("words", F.coalesce(shared * F.col("times"), F.lit(0)))
    return met.groupBy("row", "id", "key", "size", "source_size", "target").agg(F.sum("words").alias("taken"))


def repeat_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents: every row as often as it was taken, rounded to whole documents; its columns are kept.

    Rows with equal id, text and source are given out as copies of one of them.
    """
    with scratch(docs.sparkSession):
        times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
        taken = _taken(docs, weights, share, cap, block_words, id_col, text_col, source_col).withColumn("times", times)
        taken = taken.groupBy("id", "key").agg(F.sum("times").cast("int").alias("times"), F.count("*").alias("rows")).where("times > 0")
        taken = materialise(taken.toDF("of_id", "of_key", "times", "rows"), "mix-times", keep=True)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(whole, F.col(f"`{id_col}`").alias("id"), _key(id_col, text_col, source_col).alias("key"))
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key"))
    single = rows.join(taken.where("rows = 1"), same).select("doc", "times")
    repeated = rows.join(taken.where("rows > 1"), same).groupBy("id", "key", "times").agg(F.first("doc").alias("doc")).select("doc", "times")
    return single.unionByName(repeated).select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")
