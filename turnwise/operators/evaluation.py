"""Speakers, words and scores held against references: diarisation, abstention, band joins, packs and assignments."""

from __future__ import annotations

import itertools
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnwise.registry import register
from turnwise.sources.tables import calls, hits, oracle, turns

#: Tenths of a second of a bucket in which spans meet, and of the slack of a band join.
BUCKET_DS, SLACK_DS = 600, 3
#: Shares of a span that its cluster has to cover and a second one may; speakers that are matched one to one.
COVERS, SECOND, MAX_SPEAKERS = 60, 20, 8
#: Scores of a merged answer without a pick and with one, and picks that a segment may have.
NOT_FIRED, FIRED, MAX_PICKS = 95, 5, 2
WORD = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anonymous speaker spans: the turns, shifted a little."""
    shift = F.col("turn") * 7 % 31
    return turns(spark, sf_dir).select("conv_id", (F.col("turn") % 3).alias("cluster"), (F.col("start_ds") + shift).alias("c_start"), (F.col("end_ds") + shift).alias("c_end"))


_CLUSTERS = ", clusters AS (SELECT conv_id, turn % 3 AS cluster, start_ds + turn * 7 % 31 AS c_start, end_ds + turn * 7 % 31 AS c_end FROM turns)"


def overlaps(spans: DataFrame, others: DataFrame, key: str, slack: int = 0, bucket: int = BUCKET_DS) -> DataFrame:
    """Pairs of spans(start_ds, end_ds) and others(c_start, c_end) of one key that overlap when spans are wider by the slack.

    They meet in buckets of time, so that a long call is spread over tasks; a pair counts in its first common bucket only.
    """
    low, high = F.col("start_ds") - slack, F.col("end_ds") + slack
    cut = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(b / bucket)))
    left = spans.withColumn("bucket", cut(low, high))
    right = others.withColumn("bucket", cut(F.col("c_start"), F.col("c_end")))
    met = left.join(right, [key, "bucket"]).where((F.col("c_start") < high) & (F.col("c_end") > low))
    return met.where(F.col("bucket") == F.floor(F.greatest(low, F.col("c_start")) / bucket)).drop("bucket")


@register(
    "jn15_span_clusters",
    oracle(f"""{_CLUSTERS},
s AS (SELECT t.conv_id, t.turn, cluster, end_ds - start_ds AS span, sum(least(end_ds, c_end) - greatest(start_ds, c_start)) AS ds FROM turns t JOIN clusters c ON t.conv_id = c.conv_id AND c_start < end_ds AND c_end > start_ds GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ds DESC, cluster) AS nth FROM s),
p AS (SELECT conv_id, turn, span, max(CASE WHEN nth = 1 THEN ds END) AS one, max(CASE WHEN nth = 1 THEN cluster END) AS cluster, coalesce(max(CASE WHEN nth = 2 THEN ds END), 0) AS two FROM r GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN one * 100 >= {COVERS} * span AND two * 100 <= {SECOND} * span THEN 'speaker_' || (cluster + 1) END AS cluster FROM p"""),
)
def jn15_span_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster that covers a turn; none when it covers too little or a second one too much."""
    t = turns(spark, sf_dir).where("end_ds > start_ds").select("conv_id", "turn", "start_ds", "end_ds")
    shared = F.least("end_ds", "c_end") - F.greatest("start_ds", "c_start")
    per = overlaps(t, _clusters(spark, sf_dir), "conv_id").groupBy("conv_id", "turn", "cluster", (F.col("end_ds") - F.col("start_ds")).alias("span")).agg(F.sum(shared).alias("ds"))
    ranked = per.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.desc("ds"), "cluster")))
    pick = lambda n, c: F.max(F.when(F.col("nth") == n, F.col(c)))
    top = ranked.groupBy("conv_id", "turn", "span").agg(pick(1, "ds").alias("one"), pick(1, "cluster").alias("c"), F.coalesce(pick(2, "ds"), F.lit(0)).alias("two"))
    sure = (F.col("one") * 100 >= F.col("span") * COVERS) & (F.col("two") * 100 <= F.col("span") * SECOND)
    return top.select("conv_id", "turn", F.when(sure, F.concat(F.lit("speaker_"), (F.col("c") + 1).cast("string"))).alias("cluster"))


@register(
    "jn16_slack_band",
    oracle(f"""{_CLUSTERS}
SELECT t.conv_id, t.turn, count(*) AS near, sum(least(end_ds + {SLACK_DS}, c_end) - greatest(start_ds - {SLACK_DS}, c_start)) AS shared_ds FROM turns t JOIN clusters c ON t.conv_id = c.conv_id AND c_start < end_ds + {SLACK_DS} AND c_end > start_ds - {SLACK_DS} GROUP BY 1, 2"""),
)
def jn16_slack_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the other stream that overlap a turn widened by the slack on either side."""
    t = turns(spark, sf_dir).select("conv_id", "turn", "start_ds", "end_ds")
    shared = F.least(F.col("end_ds") + SLACK_DS, F.col("c_end")) - F.greatest(F.col("start_ds") - SLACK_DS, F.col("c_start"))
    return overlaps(t, _clusters(spark, sf_dir), "conv_id", SLACK_DS).groupBy("conv_id", "turn").agg(F.count("*").alias("near"), F.sum(shared).alias("shared_ds"))


def word_list(text: Column) -> Column:
    """Words of a reference or hypothesis: letters and digits, apostrophes inside."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "’", "'")), F.lit(WORD), 0)


@register("str38_wer_words", oracle(rf"SELECT conv_id, turn, CAST(len(w) AS INTEGER) AS n, array_to_string(w, ' ') AS words FROM (SELECT conv_id, turn, regexp_extract_all(lower(replace(text, '’', '''')), '{WORD.replace(chr(39), chr(39) * 2)}') AS w FROM turns)"))
def str38_wer_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = word_list(F.col("text"))
    return turns(spark, sf_dir).select("conv_id", "turn", F.size(w).alias("n"), F.array_join(w, " ").alias("words"))


def speaker_errors(spans: list[tuple[int, str, float, float]], length: float) -> dict:
    """Missed, false and confused speaker time of spans (side, speaker, start, end); side 0 is the reference.

    Speakers of both sides are matched one to one so that most time agrees; overlapped speech counts for each speaker.
    """
    clipped = [(side, who, max(0, a), min(length, b)) for side, who, a, b in spans if min(length, b) > max(0, a)]
    names = [sorted({w for s, w, _, _ in clipped if s == side}) for side in (0, 1)]
    if max(map(len, names)) > MAX_SPEAKERS:
        raise ValueError(f"more than {MAX_SPEAKERS} speakers")
    edges = sorted({0, length, *(x for _, _, a, b in clipped for x in (a, b))})
    agree: dict = defaultdict(float)
    whole = missed = false = both = 0
    for a, b in itertools.pairwise(edges):
        said = [{w for s, w, x, y in clipped if s == side and x < b and y > a} for side in (0, 1)]
        r, h = map(len, said)
        whole += (b - a) * r
        missed += (b - a) * max(0, r - h)
        false += (b - a) * max(0, h - r)
        both += (b - a) * min(r, h)
        for pair in itertools.product(*said):
            agree[pair] += b - a
    slots = [*names[0], *[None] * max(0, len(names[1]) - len(names[0]))]
    best = max((sum(agree[r, h] for r, h in zip(chosen, names[1], strict=True)) for chosen in itertools.permutations(slots, len(names[1]))), default=0)
    confused = max(0, both - best)
    return {"reference": whole, "missed": missed, "false": false, "confused": confused, "der": (missed + false + confused) / whole if whole else None}


def diarisation(reference: DataFrame, hypothesis: DataFrame, key: str) -> DataFrame:
    """(key, reference, missed, false, confused, der) of each key's spans(key, speaker, start, end), clipped to the last end of the reference."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        length = f.loc[f["side"] == 0, "end"].max()
        out = speaker_errors(list(zip(f["side"], f["speaker"], f["start"], f["end"], strict=True)), length) if length > 0 else {"reference": 0, "missed": 0, "false": 0, "confused": 0, "der": None}
        return pd.DataFrame([{"key": f["key"].iloc[0], **out}])

    side = lambda df, n: df.select(F.col(key).alias("key"), F.lit(n).alias("side"), F.col("speaker").cast("string").alias("speaker"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    return side(reference, 0).unionByName(side(hypothesis, 1)).groupBy("key").applyInPandas(run, "key bigint, reference double, missed double, false double, confused double, der double").withColumnRenamed("key", key)


@register("ag32_diarisation_errors")
def ag32_diarisation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = turns(spark, sf_dir).select("conv_id", "speaker", F.col("start_ds").alias("start"), F.col("end_ds").alias("end"))
    return diarisation(reference, _clusters(spark, sf_dir).select("conv_id", F.col("cluster").alias("speaker"), F.col("c_start").alias("start"), F.col("c_end").alias("end")), "conv_id")


@register(
    "fn29_merged_answers",
    oracle(f"""
, o AS (SELECT call_id, category_id, category_id < 3 AS ruled, max(confidence_pct) AS score FROM hits GROUP BY ALL),
n AS (SELECT call_id, max(CASE WHEN ruled THEN score END) >= 50 AS fired, 100 - max(CASE WHEN NOT ruled THEN score END) AS other_none FROM o GROUP BY 1),
r AS (SELECT *, CASE WHEN score >= 50 THEN row_number() OVER (PARTITION BY call_id ORDER BY score >= 50 DESC, score DESC, NOT ruled, category_id) END AS nth FROM o)
SELECT r.call_id, r.category_id, CASE WHEN nth > {MAX_PICKS} THEN 0 ELSE score END AS score,
  CASE WHEN fired THEN least({FIRED}, coalesce(other_none, 100)) ELSE least({NOT_FIRED}, coalesce(other_none, 100)) END AS none_score FROM r JOIN n USING (call_id)"""),
)
def fn29_merged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two classifiers with options of their own, as one answer: at most two picks, rules first on ties; 'none' is the smaller of both."""
    ruled = (F.col("category_id") < 3).alias("ruled")
    o = hits(spark, sf_dir).groupBy("call_id", "category_id", ruled).agg(F.max("confidence_pct").alias("score"))
    fired = F.coalesce(F.max(F.when(F.col("ruled"), F.col("score"))) >= 50, F.lit(False))
    n = o.groupBy("call_id").agg(fired.alias("fired"), F.coalesce(100 - F.max(F.when(~F.col("ruled"), F.col("score"))), F.lit(100)).alias("other_none"))
    picked = F.col("score") >= 50
    nth = F.row_number().over(Window.partitionBy("call_id").orderBy(picked.desc(), F.desc("score"), ~F.col("ruled"), "category_id"))
    score = F.when(picked & (nth > MAX_PICKS), 0).otherwise(F.col("score"))
    none = F.least(F.when(F.col("fired"), FIRED).otherwise(NOT_FIRED), F.col("other_none"))
    return o.withColumn("score", score).join(n, "call_id").select("call_id", "category_id", "score", none.alias("none_score"))


@register(
    "str43_observations",
    oracle("""
, o AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'promise' WHEN 1 THEN 'complaint' WHEN 2 THEN 'refund' ELSE 'other' END AS kind, CASE WHEN turn % 5 = 0 THEN upper(substr(text, 3, 12)) ELSE substr(text, 3, 12) END AS quote, CASE WHEN turn % 2 = 0 THEN 'AGENT' ELSE 'CALLER' END AS expected FROM turns)
SELECT DISTINCT o.conv_id, o.turn, kind, instr(text, quote) AS place FROM o JOIN turns t ON o.conv_id = t.conv_id AND o.turn = t.turn WHERE kind <> 'other' AND speaker = expected AND length(quote) >= 3 AND instr(text, quote) > 0"""),
)
def str43_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a model's observations those of a known kind whose quote stands in the turn that it names, said by whom it should be; each once."""
    t, part = turns(spark, sf_dir), F.substring("text", 3, 12)
    kind = F.element_at(F.array(*map(F.lit, ("promise", "complaint", "refund", "other"))), (F.col("turn") % 4 + 1).cast("int"))
    told = t.select("conv_id", "turn", kind.alias("kind"), F.when(F.col("turn") % 5 == 0, F.upper(part)).otherwise(part).alias("quote"), F.when(F.col("turn") % 2 == 0, "AGENT").otherwise("CALLER").alias("speaker"))
    place = F.expr("instr(text, quote)").cast("bigint")
    seen = told.where("kind IN ('promise', 'complaint', 'refund') AND length(quote) >= 3").join(t.select("conv_id", "turn", "speaker", "text"), ["conv_id", "turn", "speaker"])
    return seen.select("conv_id", "turn", "kind", place.alias("place")).where("place > 0").distinct()


def pack(costs: list[int], budget: int) -> list[int | None]:
    """The batch of each item in order, packed while the sum stays within the budget; None for one that does not fit alone."""
    out: list[int | None] = []
    batch, filled = 0, 0
    for cost in costs:
        if cost > budget:
            out.append(None)
            continue
        if filled and filled + cost > budget:
            batch, filled = batch + 1, 0
        filled += cost
        out.append(batch)
    return out


@register("wn20_token_batches")
def wn20_token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call's turns in batches of 120 words at most; longer ones are over budget and never cut."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("turn")
        f["batch"] = pd.array(pack(f["words"].tolist(), 120), "Int64")
        return f[["conv_id", "turn", "words", "batch"]]

    return turns(spark, sf_dir).select("conv_id", "turn", "words").groupBy("conv_id").applyInPandas(run, "conv_id bigint, turn bigint, words bigint, batch bigint")


def assign(items: int, reviewers: list[tuple[str, int, float]]) -> list[str]:
    """For each item the reviewer (name, pending, weight) with the least pending work for their weight, then by name; each pick adds to it."""
    pending = {name: n for name, n, _ in reviewers}
    weight = {name: max(w, 0.1) for name, _, w in reviewers}
    out = []
    for _ in range(items):
        name = min(pending, key=lambda x: (pending[x] / weight[x], x))
        pending[name] += 1
        out.append(name)
    return out


def least_outstanding(items: DataFrame, reviewers: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The items of each group, in order, with the reviewer that `assign` picks: the one with the least pending work for their weight, then by name.

    reviewers: group, reviewer, pending, weight. A reviewer's picks stand at (pending + picks) / weight, which
    only grows, so the n-th item goes to the n-th of all reviewers' picks in that order.
    """
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    counts = items.groupBy(group).agg(F.count("*").alias("n"))
    picks = reviewers.join(counts, group).select(group, "reviewer", "pending", F.greatest("weight", F.lit(0.1)).alias("weight"), "n", F.explode(F.expr("sequence(0L, n - 1)")).alias("picks"))
    place = F.row_number().over(Window.partitionBy(group).orderBy((F.col("pending") + F.col("picks")).cast("double") / F.col("weight"), "reviewer"))
    picked = picks.withColumn("nth", place).where("nth <= n").select(group, "nth", "reviewer")
    return items.withColumn("nth", nth).join(picked, [group, "nth"]).drop("nth")


@register("wn24_least_outstanding")
def wn24_least_outstanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An agent's calls that need a review, in order, to three reviewers of different weights."""
    items = calls(spark, sf_dir).where("requires_review").select("agent_id", "call_id", "created_at")
    each = F.array(*[F.struct(F.lit(name).alias("reviewer"), pending.cast("bigint").alias("pending"), F.lit(weight).alias("weight")) for name, pending, weight in (("ann", F.pmod("agent_id", F.lit(3)), 1.0), ("bo", F.lit(0), 2.0), ("cy", F.lit(1), 0.0))])
    reviewers = items.select("agent_id").distinct().select("agent_id", F.explode(each).alias("r")).select("agent_id", "r.*")
    return least_outstanding(items, reviewers, "agent_id", ["created_at", "call_id"]).select("agent_id", "call_id", "reviewer")
