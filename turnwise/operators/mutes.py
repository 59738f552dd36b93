"""What to mute in a recording, and where someone speaks in it: spans of text put on word times, runs of loud frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnwise.functions.vocabulary import locate_words
from turnwise.operators.intervals import merge_intervals
from turnwise.registry import register
from turnwise.sources.tables import oracle, table, turns


def merged_spans(spans: Column) -> Column:
    """Spans (begin, end, ...) of one text that overlap or touch as one, in order; its `by_place` is true if that of any is."""
    none = F.array().cast("array<struct<begin:int,end:int,by_place:boolean>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"), (last["by_place"] | s["by_place"]).alias("by_place"))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= s["begin"]), F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), grown)).otherwise(F.array_append(acc, s))

    return F.aggregate(F.array_sort(spans), none, step)


def mute_intervals(rows: DataFrame, unit: str, pad: float | int) -> DataFrame:
    """(unit, start, end): the times of a unit to mute, as a union.

    rows: unit, text, start, end (null if unknown), words (array of word, start, end), entities
    (array of start, end: sensitive ones that have times) and spans (array of begin, end,
    by_place: masked for its place, not for its value). A span takes the time of the words
    that it touches, words looked up in order; a word that is not found stands where the search is. A
    turn with spans is muted whole if nothing gives it a time, or if a span for its place touches
    no timed word; without its own times it is then left out. `pad` goes to both sides.
    """
    placed = locate_words(F.col("text"), F.transform("words", lambda w: w["word"]), keep_lost=True)
    timed = F.filter(F.zip_with("words", "places", lambda w, p: F.struct(p["begin"].alias("begin"), p["end"].alias("end"), w["start"].alias("start"), w["end"].alias("until"))), lambda w: w["start"].isNotNull() & w["until"].isNotNull())
    inside = F.filter(F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int,by_place:boolean>>")), lambda s: (s["begin"] >= 0) & (s["begin"] < s["end"]) & (s["end"] <= F.length("text")))
    kind = rows.schema["start"].dataType.simpleString()
    t = rows.withColumn("spans", inside).where(F.size("spans") > 0).withColumn("spans", merged_spans(F.col("spans"))).withColumn("places", placed).withColumn("timed", timed)
    touched = F.transform("spans", lambda s: F.struct(s["by_place"].alias("by_place"), F.filter("timed", lambda w: (w["end"] > s["begin"]) & (w["begin"] < s["end"])).alias("words")))
    t = t.withColumn("touched", touched)
    known = lambda x: F.size(x["words"]) > 0
    aligned = F.transform(F.filter("touched", known), lambda x: F.struct(F.array_min(F.transform(x["words"], lambda w: w["start"])).alias("start"), F.array_max(F.transform(x["words"], lambda w: w["until"])).alias("end")))
    entities = F.filter(F.coalesce("entities", F.array().cast(f"array<struct<start:{kind},end:{kind}>>")), lambda e: e["start"].isNotNull() & e["end"].isNotNull())
    precise = F.concat(aligned, F.transform(entities, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))))
    lost = F.exists("touched", lambda x: x["by_place"] & ~known(x))
    whole = F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), F.array(F.struct("start", "end"))).otherwise(F.array().cast(f"array<struct<start:{kind},end:{kind}>>"))
    chosen = F.when((F.size(precise) > 0) & ~lost, precise).otherwise(whole)
    each = t.select(unit, F.explode(chosen).alias("i")).select(unit, F.greatest(F.lit(0).cast(kind), F.col("i.start") - pad).alias("start"), (F.col("i.end") + pad).alias("end"))
    return merge_intervals(each, [unit], "start", "end")


@register(
    "ses06_mute_intervals",
    oracle(
        r""", w AS (SELECT conv_id, turn, text, start_ds * 10 AS s, end_ds * 10 AS e, regexp_extract_all(text, '\S+') AS ws FROM turns)
        , k AS (SELECT *, len(ws) AS n, (conv_id * 13 + turn * 7) % (length(text) + 1) AS b FROM w WHERE (conv_id + turn) % 3 = 0 AND length(text) > 0)
        , sp AS (SELECT conv_id, turn, CAST(b AS INTEGER) AS b, CAST(least(b + 9, length(text)) AS INTEGER) AS f FROM k WHERE b < length(text))
        , r(conv_id, turn, text, ws, i, p, b) AS (
          SELECT conv_id, turn, text, ws, 0, 0, NULL::INTEGER FROM k
          UNION ALL SELECT conv_id, turn, text, ws, i + 1, p + q - 1 + length(ws[i + 1]), p + q - 1 FROM (SELECT *, instr(substr(text, p + 1), ws[i + 1]) AS q FROM r WHERE i < len(ws))
        )
        , t AS (SELECT k.conv_id, k.turn, r.b AS b, r.p AS f, s + (e - s) * (i - 1) // n AS s, s + (e - s) * i // n AS e FROM r JOIN k USING (conv_id, turn) WHERE i > 0 AND i % 4 <> 0)
        , h AS (SELECT sp.conv_id, sp.turn, min(t.s) AS s, max(t.e) AS e FROM sp LEFT JOIN t ON t.conv_id = sp.conv_id AND t.turn = sp.turn AND t.f > sp.b AND t.b < sp.f GROUP BY 1, 2)
        , m AS (SELECT h.conv_id, greatest(0, coalesce(h.s, w.s) - 10) AS a, coalesce(h.e, w.e) + 10 AS z FROM h JOIN w USING (conv_id, turn))
        , o AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY conv_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM m)
        , u AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS run FROM o)
        SELECT conv_id, CAST(min(a) AS BIGINT) AS start, CAST(max(z) AS BIGINT) AS "end" FROM u GROUP BY conv_id, run"""
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def ses06_mute_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine masked letters in every third turn, in hundredths of seconds; every fourth word has no time, so a span on it alone mutes the turn."""
    t = turns(spark, sf_dir).select("conv_id", "turn", "text", (F.col("start_ds") * 10).alias("start"), (F.col("end_ds") * 10).alias("end"), F.regexp_extract_all("text", F.lit(r"\S+"), 0).alias("ws"))
    at = lambda i: F.col("start") + F.call_function("div", (F.col("end") - F.col("start")) * i, F.size("ws"))
    words = F.transform("ws", lambda w, i: F.struct(w.alias("word"), F.when((i + 1) % 4 != 0, at(i)).alias("start"), at(i + 1).alias("end")))
    begin = ((F.col("conv_id") * 13 + F.col("turn") * 7) % (F.length("text") + 1)).cast("int")
    span = F.struct(begin.alias("begin"), F.least(begin + 9, F.length("text")).alias("end"), F.lit(True).alias("by_place"))
    some = (F.col("conv_id") + F.col("turn")) % 3 == 0
    rows = t.select("conv_id", "text", "start", "end", words.alias("words"), F.when(some, F.array(span)).alias("spans"), F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("entities"))
    return mute_intervals(rows, "conv_id", 10)


def speech_runs(frames: DataFrame, channel: str, nth: str, energy: str, floor: float, hangover: int, least: int, share: float = 0.15, factor: float = 2.5) -> DataFrame:
    """(channel, begin, end): runs of loud frames, end exclusive.

    Loud is what reaches `floor` and `factor` times the channel's energy at rank `share` of its
    frames. A run ends before `hangover` quiet frames in a row; runs of fewer than `least` frames
    are dropped. Channels are summed by energy before they are ranked, so that only distinct
    energies are sorted, and runs are islands of the loud frames alone.
    """
    by_energy = frames.groupBy(channel, energy).agg(F.count("*").alias("n"))
    up_to = Window.partitionBy(channel).orderBy(energy)
    ranked = by_energy.withColumn("upto", F.sum("n").over(up_to.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(channel)))
    limits = ranked.where(F.col("upto") > F.floor(F.col("all") * share)).groupBy(channel).agg(F.greatest(F.lit(floor), F.min(energy) * factor).alias("limit"))
    loud = frames.join(limits, channel).where(F.col(energy) >= F.col("limit")).select(channel, nth)
    order = Window.partitionBy(channel).orderBy(nth)
    quiet = F.col(nth) - F.lag(nth).over(order) - 1
    runs = loud.withColumn("run", F.sum(F.when(quiet < max(hangover, 1), 0).otherwise(1)).over(order)).groupBy(channel, "run").agg(F.min(nth).alias("begin"), (F.max(nth) + 1).alias("end"))
    return runs.where(F.col("end") - F.col("begin") >= least).drop("run")


@register(
    "wn21_speech_runs",
    """WITH f AS (SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS nth, value AS energy FROM events),
    l AS (SELECT channel, greatest(12.0, 2.5 * list_sort(list(energy))[CAST(floor(count(*) * 0.15) AS BIGINT) + 1]) AS lim FROM f GROUP BY 1),
    a AS (SELECT channel, nth, nth - lag(nth) OVER (PARTITION BY channel ORDER BY nth) - 1 AS quiet FROM f JOIN l USING (channel) WHERE energy >= lim),
    r AS (SELECT *, sum(CASE WHEN quiet < 3 THEN 0 ELSE 1 END) OVER (PARTITION BY channel ORDER BY nth ROWS UNBOUNDED PRECEDING) AS run FROM a)
    SELECT channel, CAST(min(nth) AS INTEGER) AS begin, CAST(max(nth) + 1 AS INTEGER) AS "end" FROM r GROUP BY channel, run HAVING max(nth) + 1 - min(nth) >= 4""",
)
def wn21_speech_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the frames of a channel."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    frames = table(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), nth.alias("nth"), F.col("value").alias("energy"))
    return speech_runs(frames, "channel", "nth", "energy", 12.0, 3, 4)
