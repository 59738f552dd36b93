"""Scalar, map, JSON, date and digest functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnwise.operators.metrics import ratio
from turnwise.registry import register
from turnwise.sources.tables import calls, hits, oracle, table, turns, usage, verdicts


@register("fn01_time_text", oracle("SELECT call_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS at FROM calls"))
def fn01_time_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width UTC text, whose order is the order of time."""
    return calls(spark, sf_dir).select("call_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"))


def any_date(text: Column) -> Column:
    """ISO from ISO or slashed dates (month first), '--MM-DD' without a year; NULL for anything else."""
    iso = F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd")
    slash = F.date_format(F.try_to_date(text, "M/d/yyyy"), "yyyy-MM-dd")
    short = F.when(text.rlike(r"^\d{1,2}/\d{1,2}$"), F.concat(F.lit("--"), F.lpad(F.split(text, "/")[0], 2, "0"), F.lit("-"), F.lpad(F.split(text, "/")[1], 2, "0")))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso).when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), slash).otherwise(short)


@register(
    "fn02_any_date",
    oracle("SELECT call_id, CASE WHEN call_id % 3 = 2 THEN strftime(created_at, '--%m-%d') ELSE strftime(created_at, '%Y-%m-%d') END AS normal FROM calls"),
)
def fn02_any_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    text = F.when(F.col("call_id") % 3 == 0, F.date_format("created_at", "yyyy-MM-dd")).when(F.col("call_id") % 3 == 1, F.date_format("created_at", "M/d/yyyy")).otherwise(F.date_format("created_at", "M/d"))
    return c.select("call_id", any_date(text).alias("normal"))


@register("fn05_tone", oracle("SELECT call_id, 55 * (score_tenths % 101) + 25 * (call_id % 101) + 20 * (100 - least(100, 2 * abs(agent_id % 101 - 50))) AS tone FROM calls"))
def fn05_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite of valence, dominance and arousal's distance from the middle, in ten-thousandths."""
    tone = F.expr("55 * (score_tenths % 101) + 25 * (call_id % 101) + 20 * (100 - least(100, 2 * abs(agent_id % 101 - 50)))")
    return calls(spark, sf_dir).select("call_id", tone.alias("tone"))


@register("fn06_backoff", oracle("SELECT event_id, least(30 * power(2, event_id % 8 - 1), 900.0) AS wait_s FROM attempts"))
def fn06_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base * factor^(n - 1), capped."""
    return usage(spark, sf_dir).select("event_id", F.least(F.lit(30) * F.pow(F.lit(2.0), F.col("event_id") % 8 - 1), F.lit(900.0)).alias("wait_s"))


@register("fn07_urgency", oracle("SELECT call_id, least(1000, CASE WHEN critical THEN 600 ELSE 0 END + CASE WHEN requires_review THEN 300 ELSE 0 END + greatest(0, 1000 - score_tenths) // 10) AS urgency_tenths FROM calls"))
def fn07_urgency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("call_id", F.expr("least(1000, IF(critical, 600, 0) + IF(requires_review, 300, 0) + greatest(0, 1000 - score_tenths) div 10)").alias("urgency_tenths"))


@register("fn09_reason", oracle("SELECT call_id, array_to_string(list_filter([CASE WHEN critical THEN 'critical failure' END, CASE WHEN requires_review THEN 'needs review' END, CASE WHEN score_tenths < 500 THEN 'score ' || score_tenths // 10 END], lambda x: x IS NOT NULL), '; ') AS reason FROM calls"))
def fn09_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (F.when(F.col("critical"), "critical failure"), F.when(F.col("requires_review"), "needs review"), F.when(F.col("score_tenths") < 500, F.concat(F.lit("score "), F.expr("score_tenths div 10").cast("string"))))
    return calls(spark, sf_dir).select("call_id", F.concat_ws("; ", *parts).alias("reason"))


@register(
    "fn14_vote_argmax",
    oracle("SELECT call_id, max_by(subcategory_id, (votes, -subcategory_id)) AS subcategory_id FROM (SELECT call_id, subcategory_id, count(*) AS votes FROM hits GROUP BY 1, 2) GROUP BY 1"),
)
def fn14_vote_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most voted subcategory; the first of equals."""
    votes = hits(spark, sf_dir).groupBy("call_id", "subcategory_id").agg(F.count("*").alias("votes"))
    return votes.groupBy("call_id").agg(F.max_by("subcategory_id", F.struct("votes", -F.col("subcategory_id"))).alias("subcategory_id"))


@register("fn16_threshold", oracle("SELECT call_id, category_id, max(confidence_pct) >= coalesce(CASE WHEN category_id % 2 = 0 THEN 60 END, CASE WHEN category_id = 3 THEN 70 END, 50) AS fires FROM hits GROUP BY 1, 2"))
def fn16_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An administrator's threshold, or the engine's, or the built-in one."""
    limit = F.coalesce(F.when(F.col("category_id") % 2 == 0, 60), F.when(F.col("category_id") == 3, 70), F.lit(50))
    return hits(spark, sf_dir).groupBy("call_id", "category_id").agg(F.max("confidence_pct").alias("c")).select("call_id", "category_id", (F.col("c") >= limit).alias("fires"))


@register(
    "fn18_sparse_map",
    oracle("SELECT call_id, array_to_string(list_sort(list(category_id || '=' || c) FILTER (c >= 20)), ',') AS kept FROM (SELECT call_id, category_id, max(confidence_pct) AS c FROM hits GROUP BY 1, 2) GROUP BY 1"),
)
def fn18_sparse_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only options over a floor stay in a call's map."""
    per = hits(spark, sf_dir).groupBy("call_id", "category_id").agg(F.max("confidence_pct").alias("c")).groupBy("call_id").agg(F.map_from_entries(F.collect_list(F.struct("category_id", "c"))).alias("m"))
    kept = F.map_filter("m", lambda k, v: v >= 20)
    text = F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")))), ",")
    return per.select("call_id", F.when(F.size(kept) > 0, text).alias("kept"))


@register("fn20_hit_id", oracle("SELECT hit_key, call_id, turn_id, 'h-' || substr(sha256(call_id || ':' || turn_id || ':' || hit_key), 1, 16) AS hit_id FROM hits"))
def fn20_hit_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("call_id", "turn_id", "hit_key")]), 256)
    return hits(spark, sf_dir).select("hit_key", "call_id", "turn_id", F.concat(F.lit("h-"), F.substring(digest, 1, 16)).alias("hit_id"))


@register("fn22_fingerprint", oracle("SELECT conv_id, sha256(string_agg(turn || '|' || speaker || '|' || text, chr(10) ORDER BY turn)) AS fingerprint FROM turns GROUP BY 1"))
def fn22_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript's digest over its turns in order."""
    line = F.concat_ws("|", F.col("turn").cast("string"), "speaker", "text")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("fingerprint"))


@register("fn23_json_set", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"seen\":true}' AS props FROM events")
def fn23_json_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON column read into a struct, changed and written again."""
    s = F.from_json("props", "k BIGINT").withField("seen", F.lit(True))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(s).alias("props"))


@register("fn25_char_to_time", oracle("SELECT conv_id, turn, start_ds + (end_ds - start_ds) * (length(text) // 3) // greatest(length(text), 1) AS at_ds FROM turns"))
def fn25_char_to_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of the character a third into each turn, in proportion."""
    return turns(spark, sf_dir).select("conv_id", "turn", F.expr("start_ds + (end_ds - start_ds) * (length(text) div 3) div greatest(length(text), 1)").alias("at_ds"))


@register("fn26_size_class", oracle("SELECT call_id, CASE WHEN duration_seconds < 60 THEN 'XS' WHEN duration_seconds < 300 THEN 'S' WHEN duration_seconds < 900 THEN 'M' WHEN duration_seconds < 1800 THEN 'L' ELSE 'XL' END AS size_class FROM calls"))
def fn26_size_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("duration_seconds")
    return calls(spark, sf_dir).select("call_id", F.when(d < 60, "XS").when(d < 300, "S").when(d < 900, "M").when(d < 1800, "L").otherwise("XL").alias("size_class"))


@register("fn30_rule_family", oracle("SELECT DISTINCT criterion_id, CASE WHEN criterion_id % 3 = 0 THEN 'phrase' WHEN criterion_id % 3 = 1 THEN 'metric' ELSE 'semantic' END AS family FROM verdicts"))
def fn30_rule_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("criterion_id") % 3
    return verdicts(spark, sf_dir).select("criterion_id", F.when(k == 0, "phrase").when(k == 1, "metric").otherwise("semantic").alias("family")).distinct()


@register("ud06_second_opinion", oracle("SELECT a.call_id, a.criterion_id, CASE WHEN o.human_status IS NULL OR o.human_status = a.status THEN a.status ELSE 'FLAGGED' END AS status FROM verdicts a LEFT JOIN (SELECT * FROM overrides WHERE review_version = 1) o USING (call_id, criterion_id)"))
def ud06_second_opinion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two judges that disagree leave a flag."""
    from turnwise.sources.tables import overrides

    second = overrides(spark, sf_dir).where("review_version = 1").select("call_id", "criterion_id", "human_status")
    agreed = F.col("human_status").isNull() | (F.col("human_status") == F.col("status"))
    return verdicts(spark, sf_dir).join(second, ["call_id", "criterion_id"], "left").select("call_id", "criterion_id", F.when(agreed, F.col("status")).otherwise("FLAGGED").alias("status"))


@register(
    "ud08_shortcut",
    oracle("""
, per AS (SELECT call_id, category_id, subcategory_id, count(*) AS n, max(confidence_pct) AS top, max(hit_key * 29 % 101) AS near FROM hits GROUP BY ALL),
best AS (SELECT call_id, category_id, sum(n) AS hits, max(n) AS sub_n, max(top) AS score, max(near) AS near FROM per GROUP BY ALL)
SELECT call_id, category_id, hits, score >= 95 AND hits * 100 >= 80 * sum(hits) OVER (PARTITION BY call_id) AND sub_n * 100 >= 80 * hits AND near >= 75 AS shortcut FROM best"""),
)
def ud08_shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a cheap classifier is sure enough to skip the costly one: its score, the category's share of the call's votes, the subcategory's share of those, and the nearest neighbour's closeness, all at their thresholds."""
    per = hits(spark, sf_dir).groupBy("call_id", "category_id", "subcategory_id").agg(F.count("*").alias("n"), F.max("confidence_pct").alias("top"), F.max(F.col("hit_key") * 29 % 101).alias("near"))
    best = per.groupBy("call_id", "category_id").agg(F.sum("n").alias("hits"), F.max("n").alias("sub_n"), F.max("top").alias("score"), F.max("near").alias("near"))
    share = F.col("hits") * 100 >= F.sum("hits").over(Window.partitionBy("call_id")) * 80
    return best.select("call_id", "category_id", "hits", ((F.col("score") >= 95) & share & (F.col("sub_n") * 100 >= F.col("hits") * 80) & (F.col("near") >= 75)).alias("shortcut"))


@register("fn04_clamp", oracle("SELECT call_id, greatest(0.0, least(1.0, (score_tenths - 200) / 500.0))::DOUBLE AS share FROM calls"))
def fn04_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("call_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score_tenths") - 200) / F.lit(500.0))).alias("share"))


@register("fn08_review_rules", oracle("SELECT call_id, r.rule FROM calls JOIN (VALUES ('critical', true, 1001), ('low', false, 300)) r(rule, crit, below) ON (r.crit AND critical) OR (NOT r.crit AND score_tenths < r.below)"))
def fn08_review_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that a call meets, one row each: an array of matches, not a join with the rules."""
    met = F.array_compact(F.array(F.when(F.col("critical"), "critical"), F.when(F.col("score_tenths") < 300, "low")))
    return calls(spark, sf_dir).select("call_id", F.explode(met).alias("rule"))


@register("fn15_recipe", oracle("SELECT call_id, category_id, max(confidence_pct) + 10 * count_if(speaker = 'CALLER') >= 70 AS fires FROM hits GROUP BY 1, 2"))
def fn15_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base score with a bonus for lexicon hits, against a threshold."""
    score = F.max("confidence_pct") + 10 * F.count_if(F.col("speaker") == "CALLER")
    return hits(spark, sf_dir).groupBy("call_id", "category_id").agg((score >= 70).alias("fires"))


@register("fn17_subcategory_decision", oracle("SELECT call_id, CASE WHEN max(confidence_pct) < 50 THEN 'none' WHEN max(confidence_pct) >= 80 THEN 'sub-' || max_by(subcategory_id, (confidence_pct, -subcategory_id)) ELSE 'other' END AS decision FROM hits GROUP BY 1"))
def fn17_subcategory_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by("subcategory_id", F.struct("confidence_pct", -F.col("subcategory_id")))
    top = F.max("confidence_pct")
    return hits(spark, sf_dir).groupBy("call_id").agg(F.when(top < 50, "none").when(top >= 80, F.concat(F.lit("sub-"), best.cast("string"))).otherwise("other").alias("decision"))


@register("fn28_divergence", oracle("SELECT conv_id, turn, abs((conv_id * 3 + turn) % 101 - (turn * 7 + words) % 101) AS divergence_pct FROM turns"))
def fn28_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far tone and text lie apart."""
    return turns(spark, sf_dir).select("conv_id", "turn", F.expr("abs((conv_id * 3 + turn) % 101 - (turn * 7 + words) % 101)").alias("divergence_pct"))


@register("str35_dispute", oracle("SELECT conv_id, turn, contains(lower(text), 'wh') OR contains(lower(text), 'sh') OR contains(lower(text), 'ou') AS disputed FROM turns"))
def str35_dispute(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return turns(spark, sf_dir).select("conv_id", "turn", (low.contains("wh") | low.contains("sh") | low.contains("ou")).alias("disputed"))
