"""Quality metrics over calls, verdicts, reviews, hits and usage.

Percentages are 0 where nothing is measured, agreement ratios are NULL there. A call counts
as finalised if it needs no review or failed critically.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnwise.registry import register
from turnwise.sources.tables import calls, hits, latest, oracle, overrides, table, usage, verdicts

FINAL = "NOT requires_review OR critical"
STATUSES = ("PASS", "FAIL", "FLAGGED", "NOT_APPLICABLE")


def ratio(top: Column, bottom: Column) -> Column:
    """NULL where the bottom is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def percent(top: Column, bottom: Column) -> Column:
    """0 where the bottom is 0."""
    return F.coalesce(ratio(top * 100, bottom), F.lit(0.0))


def n_if(condition: str | Column) -> Column:
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition)


def scored_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that have any verdict: which one is the newest is not asked, so nothing is ranked."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call_id"))


def executive(calls: DataFrame, verdicts: DataFrame, by: Sequence[Column] = ()) -> DataFrame:
    """Counts, pass rate, mean score, breaches, escalations and hours; calls without a verdict are pending."""
    scored = calls.join(verdicts.select("call_id").distinct().withColumn("scored", F.lit(True)), "call_id", "left").withColumn("scored", F.coalesce("scored", F.lit(False)))
    final = scored.withColumn("final", F.col("scored") & F.expr(FINAL))
    return final.groupBy(*by).agg(
        F.count("*").alias("total_calls"),
        n_if("NOT scored").alias("pending_calls"),
        percent(n_if("final AND score_tenths >= 800 AND NOT critical"), n_if("final")).alias("pass_pct"),
        ratio(F.sum(F.when(F.col("final"), F.col("score_tenths"))), n_if("final") * 10).alias("avg_score"),
        n_if("scored AND critical").alias("breaches"),
        n_if("scored AND requires_review").alias("escalations"),
        ratio(F.sum("duration_seconds"), F.lit(3600)).alias("hours"),
    )


@register(
    "ag01_executive_metrics",
    oracle("""
, s AS (SELECT c.*, v.call_id IS NOT NULL AS scored FROM calls c LEFT JOIN (SELECT DISTINCT call_id FROM verdicts) v USING (call_id)),
f AS (SELECT *, scored AND (NOT requires_review OR critical) AS final FROM s)
SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS total_calls, count_if(NOT scored) AS pending_calls,
  coalesce(CAST(count_if(final AND score_tenths >= 800 AND NOT critical) * 100 AS DOUBLE) / CAST(nullif(count_if(final), 0) AS DOUBLE), 0) AS pass_pct,
  CAST(sum(score_tenths) FILTER (final) AS DOUBLE) / CAST(nullif(count_if(final), 0) * 10 AS DOUBLE) AS avg_score,
  count_if(scored AND critical) AS breaches, count_if(scored AND requires_review) AS escalations, CAST(sum(duration_seconds) AS DOUBLE) / 3600 AS hours
FROM f GROUP BY 1"""),
)
def ag01_executive_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executive(calls(spark, sf_dir), scored_calls(spark, sf_dir), [F.date_format("created_at", "yyyy-MM").alias("month")])


@register("ag02_pending_calls", oracle("SELECT stream, count(*) AS pending FROM calls c WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.call_id = c.call_id) AND state <> 'F' GROUP BY stream"))
def ag02_pending_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unscored calls, without those whose processing failed."""
    return calls(spark, sf_dir).where("state <> 'F'").join(scored_calls(spark, sf_dir), "call_id", "left_anti").groupBy("stream").agg(F.count("*").alias("pending"))


@register(
    "ag03_criterion_counts",
    oracle("""
SELECT r.criterion_id, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'FLAGGED') AS n_flagged, count(*) FILTER (status = 'NOT_APPLICABLE') AS n_not_applicable, count(status) AS n_total,
  coalesce(CAST(count(*) FILTER (status = 'PASS') * 100 AS DOUBLE) / CAST(nullif(count(*) FILTER (status IN ('PASS', 'FAIL')), 0) AS DOUBLE), 0) AS pass_pct
FROM (SELECT CAST(unnest(range(1, 10)) AS INTEGER) AS criterion_id) r LEFT JOIN verdicts v USING (criterion_id) GROUP BY 1"""),
)
def ag03_criterion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each criterion of the rubric, with zeros where it has no verdict."""
    counts = verdicts(spark, sf_dir).groupBy("criterion_id").agg(*[n_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in STATUSES], F.count("*").alias("n_total"))
    rubric = spark.range(1, 10).select(F.col("id").cast("int").alias("criterion_id"))
    filled = rubric.join(counts, "criterion_id", "left").na.fill(0)
    return filled.withColumn("pass_pct", percent(F.col("n_pass"), F.col("n_pass") + F.col("n_fail")))


@register(
    "ag04_daily_mean",
    oracle("SELECT CAST(created_at AS DATE) AS day, count(*) AS evaluated, CAST(sum(score_tenths) AS DOUBLE) / CAST(count(*) * 10 AS DOUBLE) AS mean_score FROM calls WHERE (NOT requires_review OR critical) AND EXISTS (SELECT 1 FROM verdicts v WHERE v.call_id = calls.call_id) GROUP BY 1"),
)
def ag04_daily_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = calls(spark, sf_dir).where(FINAL).join(verdicts(spark, sf_dir), "call_id", "left_semi")
    return final.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("evaluated"), ratio(F.sum("score_tenths"), F.count("*") * 10).alias("mean_score"))


def newest_overrides(overrides: DataFrame) -> DataFrame:
    return latest(overrides, ["call_id", "criterion_id"], [F.col("review_version").desc()])


def agreement(verdicts: DataFrame, overrides: DataFrame) -> DataFrame:
    """Per criterion: machine against the newest human verdict; FAIL is the positive class."""
    both = verdicts.join(newest_overrides(overrides), ["call_id", "criterion_id"], "left")
    counts = both.groupBy("criterion_id").agg(
        F.count("*").alias("machine"),
        F.count("human_status").alias("human"),
        n_if("human_status <> status").alias("overridden"),
        n_if("status = 'FAIL' AND human_status = 'FAIL'").alias("tp"),
        n_if("status = 'FAIL' AND human_status <> 'FAIL'").alias("fp"),
        n_if("status <> 'FAIL' AND human_status = 'FAIL'").alias("fn"),
    )
    return counts.select(
        "criterion_id", "machine", "human", "overridden",
        ratio(F.col("human") - F.col("overridden"), F.col("human")).alias("agreement"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("fail_precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("fail_recall"),
        ratio(F.col("human"), F.col("machine")).alias("coverage"),
    )


_NEWEST = ", newest AS (SELECT * FROM overrides QUALIFY row_number() OVER (PARTITION BY call_id, criterion_id ORDER BY review_version DESC) = 1)"


@register(
    "ag05_review_agreement",
    oracle(f"""{_NEWEST}, g AS (
SELECT criterion_id, count(*) AS machine, count(human_status) AS human, count_if(human_status <> status) AS overridden, count_if(status = 'FAIL' AND human_status = 'FAIL') AS tp,
  count_if(status = 'FAIL' AND human_status <> 'FAIL') AS fp, count_if(status <> 'FAIL' AND human_status = 'FAIL') AS fn FROM verdicts LEFT JOIN newest USING (call_id, criterion_id) GROUP BY 1)
SELECT criterion_id, machine, human, overridden, CAST(human - overridden AS DOUBLE) / nullif(human, 0) AS agreement, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS fail_precision, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS fail_recall,
  CAST(human AS DOUBLE) / nullif(machine, 0) AS coverage FROM g"""),
)
def ag05_review_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement(verdicts(spark, sf_dir), overrides(spark, sf_dir))


@register(
    "ag06_reviewed_calls",
    oracle("SELECT call_id, version, rv AS reviewed_version, rv IS NOT DISTINCT FROM version AS reviewed FROM calls LEFT JOIN (SELECT call_id, max(review_version) AS rv FROM overrides GROUP BY 1) USING (call_id)"),
)
def ag06_reviewed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call is reviewed if its newest review is of its current version (null-safe)."""
    seen = overrides(spark, sf_dir).groupBy("call_id").agg(F.max("review_version").alias("reviewed_version"))
    return calls(spark, sf_dir).select("call_id", "version").join(seen, "call_id", "left").withColumn("reviewed", F.col("reviewed_version").eqNullSafe(F.col("version")))


def current_hits(hits: DataFrame, calls: DataFrame) -> DataFrame:
    """Hits of each call's current version only."""
    return hits.join(calls.select("call_id", "version", "agent_id", "created_at"), ["call_id", "version"])


_CURRENT = ", cur AS (SELECT h.*, c.agent_id, c.created_at FROM hits h JOIN calls c USING (call_id, version))"


@register(
    "ag07_category_hit_rate",
    oracle(f"""{_CURRENT}, s AS (SELECT count(DISTINCT call_id) AS n FROM verdicts)
SELECT category_id, count(DISTINCT call_id) AS calls_hit, (SELECT n FROM s) AS calls_scored, CAST(count(DISTINCT call_id) * 100 AS DOUBLE) / (SELECT n FROM s) AS hit_pct FROM cur GROUP BY 1"""),
)
def ag07_category_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = verdicts(spark, sf_dir).agg(F.countDistinct("call_id").alias("calls_scored"))
    per = current_hits(hits(spark, sf_dir), calls(spark, sf_dir)).groupBy("category_id").agg(F.countDistinct("call_id").alias("calls_hit"))
    return per.join(F.broadcast(scored)).select("category_id", "calls_hit", "calls_scored", percent(F.col("calls_hit"), F.col("calls_scored")).alias("hit_pct"))


@register(
    "ag08_subcategory_ranking",
    oracle(f"""{_CURRENT}, g AS (SELECT category_id, subcategory_id, count(DISTINCT call_id) AS calls, count(*) AS hits FROM cur GROUP BY ALL)
SELECT *, CAST(hits * 100 AS DOUBLE) / CAST(sum(hits) OVER (PARTITION BY category_id) AS DOUBLE) AS share_pct, row_number() OVER (PARTITION BY category_id ORDER BY calls DESC, hits DESC, subcategory_id) AS place FROM g"""),
)
def ag08_subcategory_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = current_hits(hits(spark, sf_dir), calls(spark, sf_dir)).groupBy("category_id", "subcategory_id").agg(F.countDistinct("call_id").alias("calls"), F.count("*").alias("hits"))
    inside = Window.partitionBy("category_id")
    return per.withColumn("share_pct", percent(F.col("hits"), F.sum("hits").over(inside))).withColumn("place", F.row_number().over(inside.orderBy(F.desc("calls"), F.desc("hits"), "subcategory_id")))


@register(
    "ag10_precision_with_support",
    oracle("SELECT subcategory_id, count_if(human_status = 'PASS') AS confirmed, count(*) AS judged, CASE WHEN count(*) >= 5 THEN CAST(count_if(human_status = 'PASS') * 100 AS DOUBLE) / count(*) END AS precision_pct FROM hits h JOIN overrides o ON h.call_id = o.call_id AND h.turn_id = o.criterion_id AND h.version = o.review_version GROUP BY 1"),
)
def ag10_precision_with_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the hits that people judged, those confirmed; NULL below five."""
    o = overrides(spark, sf_dir).select("call_id", F.col("criterion_id").cast("bigint").alias("turn_id"), F.col("review_version").alias("version"), "human_status")
    per = hits(spark, sf_dir).join(o, ["call_id", "turn_id", "version"]).groupBy("subcategory_id").agg(n_if("human_status = 'PASS'").alias("confirmed"), F.count("*").alias("judged"))
    return per.withColumn("precision_pct", F.when(F.col("judged") >= 5, ratio(F.col("confirmed") * 100, F.col("judged"))))


@register(
    "ag11_daily_scored_and_hit",
    oracle("SELECT CAST(created_at AS DATE) AS day, count(*) AS scored, count_if(EXISTS (SELECT 1 FROM hits h WHERE h.call_id = c.call_id AND h.version = c.version)) AS with_hit FROM calls c GROUP BY 1"),
)
def ag11_daily_scored_and_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = hits(spark, sf_dir).select("call_id", "version").distinct().withColumn("hit", F.lit(True))
    return calls(spark, sf_dir).join(has, ["call_id", "version"], "left").groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("scored"), n_if("hit").alias("with_hit"))


@register("ag12_top_agents", oracle("SELECT agent_id, count(*) AS calls FROM calls GROUP BY 1 ORDER BY calls DESC, agent_id LIMIT 10"))
def ag12_top_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).groupBy("agent_id").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "agent_id").limit(10)


@register(
    "ag13_value_distribution",
    oracle("SELECT coalesce(d.value, h.value) AS value, d.value IS NOT NULL AS declared, coalesce(n, 0) AS n FROM (VALUES ('PASS'), ('FAIL'), ('WAIVED')) d(value) FULL JOIN (SELECT status AS value, count(*) AS n FROM verdicts GROUP BY 1) h ON d.value = h.value"),
)
def ag13_value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared values, with zeros, and values that were seen without being declared."""
    declared = spark.createDataFrame([("PASS",), ("FAIL",), ("WAIVED",)], "value string").withColumn("declared", F.lit(True))
    seen = verdicts(spark, sf_dir).groupBy(F.col("status").alias("value")).agg(F.count("*").alias("n"))
    return declared.join(seen, "value", "full").select("value", F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("n", F.lit(0)).alias("n"))


def usage_rollup(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attempts by any keys, NULL keys as 'none': outcomes, tokens, attempts without a token count, milliseconds."""
    named = attempts.select(*[F.coalesce(F.col(k).cast("string"), F.lit("none")).alias(k) for k in keys], "outcome", "tokens_input", "wait_ms", "inference_ms") if "outcome" not in keys else attempts
    return named.groupBy(*keys).agg(
        F.count("*").alias("attempts"),
        *[n_if(F.col("outcome") == o).alias(o.lower()) for o in ("SUCCEEDED", "FAILED", "REJECTED")],
        F.sum("tokens_input").alias("tokens_input"),
        n_if("tokens_input IS NULL").alias("without_tokens"),
        F.sum("wait_ms").alias("wait_ms"),
        F.sum("inference_ms").alias("inference_ms"),
    )


@register(
    "ag16_usage_rollup",
    oracle("""SELECT route_class, coalesce(model, 'none') AS model, count(*) AS attempts, count_if(outcome = 'SUCCEEDED') AS succeeded, count_if(outcome = 'FAILED') AS failed, count_if(outcome = 'REJECTED') AS rejected,
CAST(sum(tokens_input) AS BIGINT) AS tokens_input, count_if(tokens_input IS NULL) AS without_tokens, CAST(sum(wait_ms) AS BIGINT) AS wait_ms, CAST(sum(inference_ms) AS BIGINT) AS inference_ms FROM attempts GROUP BY 1, 2"""),
)
def ag16_usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_rollup(usage(spark, sf_dir), ["route_class", "model"])


@register("ag17_usage_cube", oracle("SELECT route_class, outcome, count(*) AS attempts, CAST(sum(inference_ms) AS BIGINT) AS inference_ms, CAST(grouping_id(route_class, outcome) AS BIGINT) AS level FROM attempts GROUP BY CUBE (route_class, outcome)"))
def ag17_usage_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).cube("route_class", "outcome").agg(F.count("*").alias("attempts"), F.sum("inference_ms").alias("inference_ms"), F.grouping_id().alias("level"))


@register(
    "ag18_attempts_per_job",
    oracle("SELECT route_class, count(*) AS attempts, count(DISTINCT job_id) AS jobs, CAST(count(*) AS DOUBLE) / count(DISTINCT job_id) AS per_job, CAST(count_if(outcome = 'REJECTED') AS DOUBLE) / count(*) AS reject_rate FROM attempts GROUP BY 1"),
)
def ag18_attempts_per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = usage(spark, sf_dir).groupBy("route_class").agg(F.count("*").alias("attempts"), F.countDistinct("job_id").alias("jobs"), n_if("outcome = 'REJECTED'").alias("rejected"))
    return per.select("route_class", "attempts", "jobs", ratio(F.col("attempts"), F.col("jobs")).alias("per_job"), ratio(F.col("rejected"), F.col("attempts")).alias("reject_rate"))


@register("ag19_medians", oracle("SELECT route_class, median(wait_ms) FILTER (outcome = 'SUCCEEDED') AS wait_median, median(inference_ms) FILTER (outcome = 'SUCCEEDED') AS inference_median FROM attempts GROUP BY 1"))
def ag19_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians over attempts that succeeded."""
    ok = F.col("outcome") == "SUCCEEDED"
    return usage(spark, sf_dir).groupBy("route_class").agg(F.median(F.when(ok, F.col("wait_ms"))).alias("wait_median"), F.median(F.when(ok, F.col("inference_ms"))).alias("inference_median"))


@register("ag20_queue_stats", oracle("SELECT stream, count(*) AS total, count_if(state = 'O') AS open_n, count_if(state = 'F') AS closed_n, count_if(requires_review AND state = 'O') AS unassigned, count_if(version < 3) AS stale FROM calls GROUP BY 1"))
def ag20_queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).groupBy("stream").agg(F.count("*").alias("total"), n_if("state = 'O'").alias("open_n"), n_if("state = 'F'").alias("closed_n"), n_if("requires_review AND state = 'O'").alias("unassigned"), n_if("version < 3").alias("stale"))


@register("ag21_backlog", oracle("SELECT agent_id, count(*) AS backlog FROM calls WHERE requires_review AND state <> 'F' GROUP BY 1"))
def ag21_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).where("requires_review AND state <> 'F'").groupBy("agent_id").agg(F.count("*").alias("backlog"))


@register("ag22_feed_bounds", oracle("SELECT min(recorded_at) AS first_at, max(event_id) AS last_seq, count(DISTINCT job_id) AS jobs FROM attempts"))
def ag22_feed_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).agg(F.min("recorded_at").alias("first_at"), F.max("event_id").alias("last_seq"), F.countDistinct("job_id").alias("jobs"))


def weighted_score(verdicts: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Share of weight passed, without NOT_APPLICABLE and FLAGGED; any FLAGGED or low confidence asks for review."""
    w = F.col("weight")
    per = verdicts.groupBy("call_id").agg(
        F.sum(F.when(F.col("status") == "PASS", w).otherwise(0)).alias("passed_weight"),
        F.sum(F.when(F.col("status").isin("PASS", "FAIL"), w).otherwise(0)).alias("assessed_weight"),
        F.bool_or(F.expr("status = 'FLAGGED' OR confidence_pct < 70")).alias("review"),
        F.bool_or(F.expr("status = 'FAIL' AND criterion_id = 1")).alias("critical"),
    )
    per = per.withColumn("score", percent(F.col("passed_weight"), F.col("assessed_weight")))
    return per.withColumn("passed", (F.col("score") >= threshold) & ~F.col("critical") & ~F.col("review") & (F.col("assessed_weight") > 0))


_SCORE = """SELECT *, score >= 80 AND NOT critical AND NOT review AND assessed_weight > 0 AS passed FROM (
SELECT *, coalesce(CAST(passed_weight * 100 AS DOUBLE) / CAST(nullif(assessed_weight, 0) AS DOUBLE), 0) AS score FROM (
SELECT call_id, CAST(sum(CASE WHEN status = 'PASS' THEN weight ELSE 0 END) AS BIGINT) AS passed_weight, CAST(sum(CASE WHEN status IN ('PASS', 'FAIL') THEN weight ELSE 0 END) AS BIGINT) AS assessed_weight,
  bool_or(status = 'FLAGGED' OR confidence_pct < 70) AS review, bool_or(status = 'FAIL' AND criterion_id = 1) AS critical FROM {} GROUP BY 1))"""


@register("ag23_weighted_score", oracle(_SCORE.format("verdicts")))
def ag23_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_score(verdicts(spark, sf_dir))


@register("ag24_reviewed_score", oracle(f"{_NEWEST}, overlaid AS (SELECT v.* REPLACE (coalesce(human_status, status) AS status) FROM verdicts v LEFT JOIN newest USING (call_id, criterion_id)) " + _SCORE.format("overlaid")))
def ag24_reviewed_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted score after the newest human verdicts replace the machine's."""
    both = verdicts(spark, sf_dir).join(newest_overrides(overrides(spark, sf_dir)), ["call_id", "criterion_id"], "left")
    return weighted_score(both.withColumn("status", F.coalesce("human_status", "status")))


@register("ag25_low_confidence", oracle("SELECT call_id, bool_or(confidence_pct < 70 OR status = 'FLAGGED') AS low_confidence FROM verdicts GROUP BY 1"))
def ag25_low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).groupBy("call_id").agg(F.bool_or(F.expr("confidence_pct < 70 OR status = 'FLAGGED'")).alias("low_confidence"))


@register(
    "ag34_dataset_minimums",
    oracle("""SELECT stream, examples, distinct_calls, CASE WHEN examples < 100 THEN 'examples' WHEN distinct_calls < 100 THEN 'calls' WHEN fails < 20 THEN 'fails' END AS unmet FROM (
SELECT stream, count(*) AS examples, count(DISTINCT call_id) AS distinct_calls, count_if(status = 'FAIL') AS fails FROM verdicts JOIN calls USING (call_id) GROUP BY 1)"""),
)
def ag34_dataset_minimums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a training set and the first minimum that it misses."""
    per = verdicts(spark, sf_dir).join(calls(spark, sf_dir).select("call_id", "stream"), "call_id").groupBy("stream").agg(F.count("*").alias("examples"), F.countDistinct("call_id").alias("distinct_calls"), n_if("status = 'FAIL'").alias("fails"))
    return per.select("stream", "examples", "distinct_calls", F.expr("CASE WHEN examples < 100 THEN 'examples' WHEN distinct_calls < 100 THEN 'calls' WHEN fails < 20 THEN 'fails' END").alias("unmet"))


@register("ag36_categories_of_call", oracle(f"{_CURRENT} SELECT call_id, array_to_string(list_sort(list_distinct(list(category_id))), ',') AS categories FROM cur GROUP BY 1"))
def ag36_categories_of_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = current_hits(hits(spark, sf_dir), calls(spark, sf_dir)).groupBy("call_id").agg(F.array_sort(F.collect_set("category_id")).alias("c"))
    return per.select("call_id", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("categories"))


@register("ag37_worst_criterion", oracle("SELECT criterion_id, count_if(status IN ('FAIL', 'FLAGGED')) AS missed FROM verdicts GROUP BY 1 ORDER BY missed DESC, criterion_id LIMIT 1"))
def ag37_worst_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).groupBy("criterion_id").agg(n_if(F.col("status").isin("FAIL", "FLAGGED")).alias("missed")).orderBy(F.desc("missed"), "criterion_id").limit(1)


@register("ag38_quantiles", oracle("SELECT stream, quantile_cont(score_tenths, 0.25) AS q25, quantile_cont(score_tenths, 0.5) AS q50, quantile_cont(score_tenths, 0.75) AS q75 FROM calls GROUP BY 1"))
def ag38_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, linearly interpolated."""
    return calls(spark, sf_dir).groupBy("stream").agg(*[F.percentile("score_tenths", F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)])


@register(
    "ag39_peer_comparison",
    oracle("""
, a AS (SELECT agent_id, count(*) AS calls, CAST(sum(score_tenths) AS DOUBLE) / count(*) AS mean FROM calls GROUP BY 1), n AS (SELECT count(*) AS peers, quantile_cont(mean, 0.25) AS low, quantile_cont(mean, 0.75) AS high FROM a)
SELECT agent_id, calls, mean, rank() OVER (ORDER BY mean DESC) AS place, peers - 1 AS peers, CASE WHEN mean >= high THEN 'top' WHEN mean < low THEN 'low' ELSE 'middle' END AS band FROM a, n"""),
)
def ag39_peer_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each agent's mean, place and band among all agents; agents are few beside calls."""
    per = calls(spark, sf_dir).groupBy("agent_id").agg(F.count("*").alias("calls"), F.sum("score_tenths").alias("s")).select("agent_id", "calls", ratio(F.col("s"), F.col("calls")).alias("mean"))
    all_of = per.agg(F.count("*").alias("n"), F.percentile("mean", F.lit(0.25)).alias("low"), F.percentile("mean", F.lit(0.75)).alias("high"))
    # How many agents have each mean, and so how many are before it.
    before = per.groupBy("mean").agg(F.count("*").alias("same")).withColumn("place", F.sum("same").over(Window.orderBy(F.desc("mean"))) - F.col("same") + 1)
    band = F.when(F.col("mean") >= F.col("high"), "top").when(F.col("mean") < F.col("low"), "low").otherwise("middle")
    return per.join(before, "mean").join(F.broadcast(all_of)).select("agent_id", "calls", "mean", "place", (F.col("n") - 1).alias("peers"), band.alias("band"))


@register(
    "ag40_chunk_mean",
    oracle("""
, k AS (SELECT conv_id, speaker, CAST(sum(words) AS BIGINT) AS total, CAST(sum(words * (conv_id * 7 + turn * 13) % 101) AS BIGINT) AS weighted FROM turns GROUP BY 1, 2)
SELECT conv_id, max_by(speaker, (CAST(weighted AS DOUBLE) / total, speaker)) AS label, max(CAST(weighted AS DOUBLE) / total) AS p FROM k WHERE total > 0 GROUP BY 1"""),
)
def ag40_chunk_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length-weighted means of chunks' values, and the label with the largest."""
    from turnwise.sources.tables import turns

    t = turns(spark, sf_dir)
    per = t.groupBy("conv_id", "speaker").agg(F.sum("words").alias("total"), F.sum(F.expr("words * (conv_id * 7 + turn * 13) % 101")).alias("weighted")).where("total > 0")
    per = per.withColumn("p", ratio(F.col("weighted"), F.col("total")))
    return per.groupBy("conv_id").agg(F.max_by("speaker", F.struct("p", "speaker")).alias("label"), F.max("p").alias("p"))


@register("ag09_judged_hits", oracle("SELECT h.subcategory_id, count_if(o.human_status = 'PASS') AS confirmed, count_if(o.human_status = 'FAIL') AS dismissed FROM hits h JOIN overrides o ON h.call_id = o.call_id AND h.turn_id = o.criterion_id AND h.version = o.review_version GROUP BY 1"))
def ag09_judged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements count only if they judged this very version of the hit."""
    o = overrides(spark, sf_dir).select("call_id", F.col("criterion_id").cast("bigint").alias("turn_id"), F.col("review_version").alias("version"), "human_status")
    return hits(spark, sf_dir).join(o, ["call_id", "turn_id", "version"]).groupBy("subcategory_id").agg(n_if("human_status = 'PASS'").alias("confirmed"), n_if("human_status = 'FAIL'").alias("dismissed"))


@register("ag15_calls_by_version", oracle("SELECT version, count(*) AS calls FROM calls GROUP BY 1"))
def ag15_calls_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).groupBy("version").agg(F.count("*").alias("calls"))


@register("ag33_promotion", oracle("SELECT criterion_id, n, correct, CASE WHEN n < 10 THEN 'few' WHEN CAST(correct AS DOUBLE) / n < 0.5 THEN 'reject' ELSE 'accept' END AS decision FROM (SELECT criterion_id, count(*) AS n, count_if(human_status = status) AS correct FROM verdicts JOIN overrides USING (call_id, criterion_id) GROUP BY 1)"))
def ag33_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy per task and what it means for a candidate."""
    per = verdicts(spark, sf_dir).join(overrides(spark, sf_dir), ["call_id", "criterion_id"]).groupBy("criterion_id").agg(F.count("*").alias("n"), n_if("human_status = status").alias("correct"))
    return per.withColumn("decision", F.when(F.col("n") < 10, "few").when(ratio(F.col("correct"), F.col("n")) < 0.5, "reject").otherwise("accept"))


@register("ag35_group_progress", oracle("SELECT agent_id, count_if(state = 'F') AS done, count_if(state = 'O') AS open_n, count_if(state = 'P') AS part, min_by(stream, (created_at, call_id)) FILTER (state = 'O') AS waits_for FROM calls GROUP BY 1"))
def ag35_group_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by state and what the first open one waits for."""
    open_at = F.when(F.col("state") == "O", F.struct("created_at", "call_id"))
    return calls(spark, sf_dir).groupBy("agent_id").agg(n_if("state = 'F'").alias("done"), n_if("state = 'O'").alias("open_n"), n_if("state = 'P'").alias("part"), F.min_by(F.when(F.col("state") == "O", F.col("stream")), open_at).alias("waits_for"))
