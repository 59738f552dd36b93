"""Intervals and sessions inside calls: unions, subtraction, gaps, signal runs, rate windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnwise.operators.metrics import ratio
from turnwise.registry import register
from turnwise.sources.tables import hits, oracle, table, turns


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Unions of intervals that touch, overlap or lie `gap` apart at most."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(F.col(start) <= reached + gap, 0).otherwise(1))
    numbered = flagged.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


_UNION = """
, o AS (SELECT *, CASE WHEN start_s <= max(end_s) OVER (PARTITION BY call_id, speaker ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS new FROM hits),
r AS (SELECT *, sum(new) OVER (PARTITION BY call_id, speaker ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS run FROM o),
u AS (SELECT call_id, speaker, min(start_s) AS start_s, max(end_s) AS end_s FROM r GROUP BY call_id, speaker, run)"""


@register("ses03_interval_union", oracle(_UNION.format(gap=0) + "SELECT * FROM u"))
def ses03_interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_intervals(hits(spark, sf_dir), ["call_id", "speaker"], "start_s", "end_s")


@register("ag29_active_seconds", oracle(_UNION.format(gap=0) + "SELECT call_id, speaker, CAST(sum(end_s - start_s) AS BIGINT) AS active_s FROM u GROUP BY 1, 2"))
def ag29_active_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_intervals(hits(spark, sf_dir), ["call_id", "speaker"], "start_s", "end_s").groupBy("call_id", "speaker").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("active_s"))


@register(
    "ag30_silence_ratio",
    oracle("""
, o AS (SELECT *, CASE WHEN start_s <= max(end_s) OVER (PARTITION BY call_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM hits),
r AS (SELECT *, sum(new) OVER (PARTITION BY call_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS run FROM o),
u AS (SELECT call_id, min(start_s) AS s, max(end_s) AS e FROM r GROUP BY call_id, run)
SELECT call_id, CAST(max(e) - min(s) - sum(e - s) AS DOUBLE) / nullif(max(e) - min(s), 0) AS silence FROM u GROUP BY 1"""),
)
def ag30_silence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a call's span in which nobody is active."""
    u = merge_intervals(hits(spark, sf_dir), ["call_id"], "start_s", "end_s").groupBy("call_id").agg((F.max("end_s") - F.min("start_s")).alias("span"), F.sum(F.col("end_s") - F.col("start_s")).alias("active"))
    return u.select("call_id", ratio(F.col("span") - F.col("active"), F.col("span")).alias("silence"))


def subtract_intervals(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Parts of a's intervals outside b's, by a sweep over all borders of a key."""
    ends = lambda df, side: df.select(*keys, F.col(start).alias("at"), F.lit(1).alias(side)).unionByName(df.select(*keys, F.col(end).alias("at"), F.lit(-1).alias(side)))
    borders = ends(a, "in_a").unionByName(ends(b, "in_b"), allowMissingColumns=True).na.fill(0, ["in_a", "in_b"]).groupBy(*keys, "at").agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b"))
    w = Window.partitionBy(*keys).orderBy("at")
    swept = borders.select(*keys, "at", F.lead("at").over(w).alias("until"), F.sum("in_a").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("a"), F.sum("in_b").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("b"))
    return merge_intervals(swept.where("a > 0 AND b = 0 AND until IS NOT NULL").select(*keys, F.col("at").alias(start), F.col("until").alias(end)), keys, start, end)


@register(
    "ses04_interval_subtract",
    oracle("""
, x AS (SELECT call_id, start_s AS t, CASE speaker WHEN 'AGENT' THEN 1 ELSE 0 END AS a, CASE speaker WHEN 'CALLER' THEN 1 ELSE 0 END AS b FROM hits UNION ALL SELECT call_id, end_s, CASE speaker WHEN 'AGENT' THEN -1 ELSE 0 END, CASE speaker WHEN 'CALLER' THEN -1 ELSE 0 END FROM hits),
y AS (SELECT call_id, t, sum(a) AS a, sum(b) AS b FROM x GROUP BY 1, 2),
z AS (SELECT call_id, t, lead(t) OVER w AS until, sum(a) OVER (w ROWS UNBOUNDED PRECEDING) AS a, sum(b) OVER (w ROWS UNBOUNDED PRECEDING) AS b FROM y WINDOW w AS (PARTITION BY call_id ORDER BY t)),
k AS (SELECT *, CASE WHEN t <= lag(until) OVER (PARTITION BY call_id ORDER BY t) THEN 0 ELSE 1 END AS new FROM z WHERE a > 0 AND b = 0 AND until IS NOT NULL),
r AS (SELECT *, sum(new) OVER (PARTITION BY call_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM k)
SELECT call_id, min(t) AS start_s, max(until) AS end_s FROM r GROUP BY call_id, run"""),
)
def ses04_interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    return subtract_intervals(h.where("speaker = 'AGENT'"), h.where("speaker = 'CALLER'"), ["call_id"], "start_s", "end_s")


@register(
    "ses05_signal_runs",
    oracle("""
, o AS (SELECT *, CASE WHEN start_s <= max(end_s) OVER (PARTITION BY call_id, speaker, category_id ORDER BY start_s, end_s, hit_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 20 THEN 0 ELSE 1 END AS new FROM hits),
r AS (SELECT *, sum(new) OVER (PARTITION BY call_id, speaker, category_id ORDER BY start_s, end_s, hit_key ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT call_id, speaker, category_id, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_hits, max(confidence_pct) AS confidence_pct, min_by(hit_key, (start_s, end_s, hit_key)) AS anchor FROM r GROUP BY call_id, speaker, category_id, run"""),
)
def ses05_signal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of one speaker and category that lie 20 s apart at most (inclusive); the first is the anchor."""
    w = Window.partitionBy("call_id", "speaker", "category_id").orderBy("start_s", "end_s", "hit_key")
    reached = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits(spark, sf_dir).withColumn("new", F.when(F.col("start_s") <= reached + 20, 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    anchor = F.min_by("hit_key", F.struct("start_s", "end_s", "hit_key"))
    return runs.groupBy("call_id", "speaker", "category_id", "run").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n_hits"), F.max("confidence_pct").alias("confidence_pct"), anchor.alias("anchor")).drop("run")


@register("ses08_rate_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS in_day FROM events")
def ses08_rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the trailing day, this one included."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(micros).rangeBetween(-86_400_000_000, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("in_day"))


@register(
    "ses10_sessions",
    """WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM g GROUP BY user_id, s""",
)
def ses10_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after six hours without an entry."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    e = table(spark, sf_dir, "events").withColumn("new", F.when(gap <= 21_600_000_000, 0).otherwise(1)).withColumn("s", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "s").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("n")).drop("s")


@register(
    "ag26_speech_weighted_mean",
    oracle("SELECT conv_id, CAST(sum((2 * ((conv_id + turn * 7) % 11) - 10) * words) AS DOUBLE) / CAST(10 * nullif(sum(words), 0) AS DOUBLE) AS valence FROM turns GROUP BY 1"),
)
def ag26_speech_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.expr("(2 * ((conv_id + turn * 7) % 11) - 10) * words")
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.sum(v).alias("v"), F.sum("words").alias("w")).select("conv_id", ratio(F.col("v"), F.col("w") * 10).alias("valence"))


@register(
    "ag27_tone_label",
    oracle("SELECT conv_id, CASE WHEN t >= 6 THEN 'warm' WHEN t >= 4 THEN 'even' ELSE 'cold' END AS tone FROM (SELECT conv_id, CAST(sum(((conv_id * 3 + turn) % 11) * words) AS DOUBLE) / CAST(nullif(sum(words), 0) AS DOUBLE) AS t FROM turns WHERE speaker = 'AGENT' GROUP BY 1)"),
)
def ag27_tone_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration-weighted tone of the agent, as a label."""
    t = turns(spark, sf_dir).where("speaker = 'AGENT'").groupBy("conv_id").agg(ratio(F.sum(F.expr("((conv_id * 3 + turn) % 11) * words")), F.sum("words")).alias("t"))
    return t.select("conv_id", F.when(F.col("t") >= 6, "warm").when(F.col("t") >= 4, "even").otherwise("cold").alias("tone"))


@register(
    "ag28_mean_with_coverage",
    oracle("SELECT conv_id, count_if(words > 3) AS samples, CASE WHEN count_if(words > 3) >= 2 AND count_if(words > 3) * 2 >= count(*) THEN CAST(sum(words) FILTER (words > 3) AS DOUBLE) / count_if(words > 3) END AS mean_words, NOT (count_if(words > 3) >= 2 AND count_if(words > 3) * 2 >= count(*)) AS flagged FROM turns GROUP BY 1"),
)
def ag28_mean_with_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured only with enough samples and half of all turns covered; flagged otherwise."""
    long = F.col("words") > 3
    per = turns(spark, sf_dir).groupBy("conv_id").agg(F.count_if(long).alias("samples"), F.count("*").alias("n"), F.sum(F.when(long, F.col("words"))).alias("s"))
    enough = (F.col("samples") >= 2) & (F.col("samples") * 2 >= F.col("n"))
    return per.select("conv_id", "samples", F.when(enough, ratio(F.col("s"), F.col("samples"))).alias("mean_words"), (~enough).alias("flagged"))
