"""Versions, logs, rankings and sequences: window operators over the call tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnwise.registry import register
from turnwise.sources.tables import calls, hits, latest, oracle, overrides, table, turns, usage, verdicts


@register("wn01_latest_version", oracle("SELECT call_id, criterion_id, review_version, human_status FROM overrides QUALIFY row_number() OVER (PARTITION BY call_id, criterion_id ORDER BY review_version DESC) = 1"))
def wn01_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(overrides(spark, sf_dir), ["call_id", "criterion_id"], [F.desc("review_version")])


@register("wn02_superseded_by", oracle("SELECT call_id, criterion_id, review_version, lead(review_version) OVER (PARTITION BY call_id, criterion_id ORDER BY review_version) AS superseded_by FROM overrides"))
def wn02_superseded_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overrides(spark, sf_dir).select("call_id", "criterion_id", "review_version", F.lead("review_version").over(Window.partitionBy("call_id", "criterion_id").orderBy("review_version")).alias("superseded_by"))


@register(
    "wn03_last_write_wins",
    "SELECT user_id AS subject, max(event_id) AS seq, max_by(event_type, event_id) AS label FROM events GROUP BY 1 HAVING max_by(event_id % 10 = 0, event_id) = false",
)
def wn03_last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest label of each subject; a newest entry that withdraws removes the subject."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("subject")).agg(F.max(F.struct("event_id", "event_type")).alias("m")).where("m.event_id % 10 <> 0").select("subject", F.col("m.event_id").alias("seq"), F.col("m.event_type").alias("label"))


@register(
    "wn03b_withdrawals",
    "SELECT user_id AS subject, count_if(gone AND NOT was) AS withdrawals FROM (SELECT user_id, event_id % 10 = 0 AS gone, coalesce(lag(event_id % 10 = 0) OVER (PARTITION BY user_id ORDER BY event_id), true) AS was FROM events) GROUP BY 1",
)
def wn03b_withdrawals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a live label was withdrawn."""
    gone = F.col("event_id") % 10 == 0
    was = F.coalesce(F.lag(gone).over(Window.partitionBy("user_id").orderBy("event_id")), F.lit(True))
    marked = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), (gone & ~was).alias("w"))
    return marked.groupBy("subject").agg(F.count_if("w").alias("withdrawals"))


@register("wn04_newest_example", "SELECT sha256(text) AS digest, max(doc_id) AS newest, count(*) - 1 AS duplicates FROM documents GROUP BY 1")
def wn04_newest_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.max("doc_id").alias("newest"), (F.count("*") - 1).alias("duplicates"))


@register(
    "wn05_carve_validation",
    oracle("SELECT stream, call_id, row_number() OVER (PARTITION BY stream ORDER BY sha256(CAST(call_id AS VARCHAR))) <= (count(*) OVER (PARTITION BY stream) + 9) // 10 AS valid FROM calls"),
)
def wn05_carve_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenth (rounded up) with the smallest digests validates."""
    by = Window.partitionBy("stream")
    nth = F.row_number().over(by.orderBy(F.sha2(F.col("call_id").cast("string"), 256)))
    return calls(spark, sf_dir).select("stream", "call_id", (nth <= F.ceil(F.count("*").over(by) / 10)).alias("valid"))


@register("wn06_context", oracle("SELECT conv_id, turn, coalesce(lag(turn) OVER w, turn) AS before, coalesce(lead(turn) OVER w, turn) AS after FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"))
def wn06_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns(spark, sf_dir).select("conv_id", "turn", F.coalesce(F.lag("turn").over(w), "turn").alias("before"), F.coalesce(F.lead("turn").over(w), "turn").alias("after"))


@register(
    "wn07_first_last_peak",
    oracle("SELECT call_id, category_id, min(turn_id) AS first_turn, max(turn_id) AS last_turn, max(confidence_pct) AS peak, CAST(max_by(turn_id, (confidence_pct, -turn_id)) AS BIGINT) AS peak_turn FROM hits GROUP BY 1, 2"),
)
def wn07_first_last_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest turn of the largest confidence is the peak."""
    return hits(spark, sf_dir).groupBy("call_id", "category_id").agg(F.min("turn_id").alias("first_turn"), F.max("turn_id").alias("last_turn"), F.max("confidence_pct").alias("peak"), F.max_by("turn_id", F.struct("confidence_pct", -F.col("turn_id"))).alias("peak_turn"))


@register("wn08_top_two", oracle("SELECT call_id, category_id, confidence_pct, hit_key FROM hits WHERE confidence_pct >= 40 QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY confidence_pct DESC, category_id, hit_key, turn_id) <= 2"))
def wn08_top_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two hits of a call over the threshold."""
    nth = F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc("confidence_pct"), "category_id", "hit_key", "turn_id"))
    return hits(spark, sf_dir).where("confidence_pct >= 40").withColumn("nth", nth).where("nth <= 2").select("call_id", "category_id", "confidence_pct", "hit_key")


@register(
    "wn10_budget",
    oracle("SELECT conv_id, turn FROM turns QUALIFY sum(words) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) <= 60"),
)
def wn10_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns from the newest back, as long as they fit 60 words."""
    used = F.sum("words").over(Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    return turns(spark, sf_dir).withColumn("used", used).where("used <= 60").select("conv_id", "turn")


@register("wn11_blocks", oracle("SELECT conv_id, unnest(range(0, max(end_ds) // 70 + 1)) AS block FROM turns GROUP BY 1"))
def wn11_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of 7-second blocks of each call."""
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.max("end_ds").alias("end")).select("conv_id", F.explode(F.expr("sequence(0L, end div 70)")).alias("block"))


@register(
    "wn16_next_two_turns",
    oracle("SELECT conv_id, turn, coalesce(string_agg(text, ' | ' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS next_two FROM turns"),
)
def wn16_next_two_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.collect_list("text").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, 2))
    return turns(spark, sf_dir).select("conv_id", "turn", F.array_join(after, " | ").alias("next_two"))


@register("wn17_neighbour_fill", oracle("SELECT conv_id, turn, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), first_value(k IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS speaker FROM (SELECT *, CASE WHEN (conv_id + turn) % 3 > 0 THEN speaker END AS k FROM turns)"))
def wn17_neighbour_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled turns take the previous known label, or else the next."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    k = F.when((F.col("conv_id") + F.col("turn")) % 3 > 0, F.col("speaker"))
    before = F.last(k, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(k, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return turns(spark, sf_dir).select("conv_id", "turn", F.coalesce(before, after).alias("speaker"))


@register("wn18_first_appearance", oracle("SELECT conv_id, speaker, dense_rank() OVER (PARTITION BY conv_id ORDER BY first_turn) AS place FROM (SELECT conv_id, speaker, min(turn) AS first_turn FROM turns GROUP BY 1, 2)"))
def wn18_first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).groupBy("conv_id", "speaker").agg(F.min("turn").alias("t")).select("conv_id", "speaker", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("t")).alias("place"))


def chain(log: DataFrame, key: str, seq: str, body: Column) -> DataFrame:
    """Each entry with its digest, the link to the entry before, and whether sequence numbers rise."""
    w = Window.partitionBy(key).orderBy(seq)
    with_digest = log.withColumn("digest", F.sha2(body, 256))
    return with_digest.select(key, seq, "digest", F.lag("digest").over(w).alias("previous"), (F.col(seq) > F.coalesce(F.lag(seq).over(w), F.lit(-1))).alias("rises"))


@register("wn22_hash_chain", "SELECT user_id, event_id, d AS digest, lag(d) OVER w AS previous, event_id > coalesce(lag(event_id) OVER w, -1) AS rises FROM (SELECT *, sha256(event_id || ':' || event_type) AS d FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def wn22_hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(table(spark, sf_dir, "events"), "user_id", "event_id", F.concat_ws(":", F.col("event_id").cast("string"), "event_type"))


@register(
    "wn23_round_robin",
    oracle("SELECT stream, call_id, (row_number() OVER (PARTITION BY stream ORDER BY created_at, call_id) - 1) % 7 AS reviewer FROM calls WHERE requires_review"),
)
def wn23_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("stream").orderBy("created_at", "call_id")) - 1
    return calls(spark, sf_dir).where("requires_review").select("stream", "call_id", (nth % 7).alias("reviewer"))


@register(
    "wn25_supersede_or_stale",
    oracle("""SELECT call_id, criterion_id, review_version, CASE WHEN review_version = max(review_version) OVER (PARTITION BY call_id, criterion_id) THEN 'current' WHEN (call_id + review_version) % 2 = 0 THEN 'stale' ELSE 'superseded' END AS state FROM overrides"""),
)
def wn25_supersede_or_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older versions: resolved ones (even sums here) are stale, open ones are superseded."""
    newest = F.max("review_version").over(Window.partitionBy("call_id", "criterion_id"))
    state = F.when(F.col("review_version") == newest, "current").when((F.col("call_id") + F.col("review_version")) % 2 == 0, "stale").otherwise("superseded")
    return overrides(spark, sf_dir).select("call_id", "criterion_id", "review_version", state.alias("state"))


@register(
    "wn26_speaker_islands",
    oracle("""
, f AS (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM turns), g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM f)
SELECT conv_id, island, any_value(speaker) AS speaker, min(turn) AS first_turn, max(turn) AS last_turn, CAST(sum(words) AS BIGINT) AS words FROM g GROUP BY 1, 2"""),
)
def wn26_speaker_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of turns of one speaker."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = F.when(F.col("speaker").eqNullSafe(F.lag("speaker").over(w)), 0).otherwise(1)
    marked = turns(spark, sf_dir).withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("conv_id", "island").agg(F.first("speaker").alias("speaker"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum("words").alias("words"))


@register("st09_transitions", "SELECT was, event_type AS now, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS NOT NULL GROUP BY ALL")
def st09_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each state follows another: what a table of legal transitions is checked against."""
    was = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(was.alias("was"), F.col("event_type").alias("now")).where("was IS NOT NULL").groupBy("was", "now").agg(F.count("*").alias("n"))


@register("wn09_top_two_by_margin", oracle("SELECT call_id, category_id, margin FROM (SELECT call_id, category_id, max(confidence_pct) - 40 AS margin FROM hits GROUP BY 1, 2) WHERE margin > 0 QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY margin DESC, category_id) <= 2"))
def wn09_top_two_by_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = hits(spark, sf_dir).groupBy("call_id", "category_id").agg((F.max("confidence_pct") - 40).alias("margin")).where("margin > 0")
    return m.withColumn("nth", F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc("margin"), "category_id"))).where("nth <= 2").drop("nth")


def pack(sizes: list[int], limit: int, most: int) -> list[int]:
    """Greedy packs in order: a pack closes when the next item would exceed its size or its number of items."""
    out, now, used, held = [], 0, 0, 0
    for n in sizes:
        if held and (used + n > limit or held == most):
            now, used, held = now + 1, 0, 0
        out.append(now)
        used, held = used + n, held + 1
    return out


@register("wn19_turn_packs")
def wn19_turn_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns packed into windows of 60 turns and 3500 bytes: each pack depends on the one before, so a fold per call."""
    import pandas as pd

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("turn")
        return pd.DataFrame({"conv_id": f["conv_id"], "turn": f["turn"], "pack": pack(f["size"].tolist(), 3500, 60)})

    t = turns(spark, sf_dir).select("conv_id", "turn", F.octet_length("text").alias("size"))
    return t.groupBy("conv_id").applyInPandas(run, "conv_id bigint, turn bigint, pack int")
