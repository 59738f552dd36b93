"""Feeds, leases, queues and alerts: retention, late corrections, edge triggers, merged requests; and reads by content."""

from __future__ import annotations

import json
import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnwise.registry import register
from turnwise.session import materialise
from turnwise.sources.tables import calls, hits, oracle, table, usage

#: Days that a feed keeps, seconds of a lease's grace, attempts, first and longest backoff.
KEEP_DAYS, GRACE_S, MAX_ATTEMPTS, BACKOFF_S, MAX_BACKOFF_S = 7, 30, 3, 30, 3600


@register(
    "st03_cursor_state",
    oracle(f"""
, kept AS (SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {KEEP_DAYS} DAY),
e AS (SELECT (SELECT min(event_id) FROM kept) AS oldest, (SELECT max(event_id) FROM events) AS newest)
SELECT c_custkey AS consumer, c_custkey * 7 AS position, CASE WHEN c_custkey * 7 > newest THEN 'unknown' WHEN c_custkey * 7 < oldest - 1 THEN 'expired' ELSE 'current' END AS state,
  CASE WHEN c_custkey * 7 <= newest AND c_custkey * 7 >= oldest - 1 THEN newest - c_custkey * 7 END AS behind FROM customer, e"""),
)
def st03_cursor_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumers' cursors against a feed that keeps its last days: a pruned position is expired, one beyond the end unknown."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("last"), F.max("event_id").alias("newest"))
    oldest = e.join(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr(f"INTERVAL {KEEP_DAYS} DAYS")).agg(F.min("event_id").alias("oldest"))
    at = F.col("c_custkey") * 7
    state = F.when(at > F.col("newest"), "unknown").when(at < F.col("oldest") - 1, "expired").otherwise("current")
    edges = F.broadcast(last.select("newest").crossJoin(oldest))
    return table(spark, sf_dir, "customer").join(edges).select(F.col("c_custkey").alias("consumer"), at.alias("position"), state.alias("state"), F.when(state == "current", F.col("newest") - at).alias("behind"))


@register(
    "st07_late_measurements",
    oracle("""
, late AS (SELECT job_id, max_by(inference_ms, event_id) AS measured FROM attempts WHERE outcome = 'SUCCEEDED' AND event_id % 3 = 0 GROUP BY 1),
made AS (SELECT job_id, max(event_id) AS event_id FROM attempts WHERE outcome = 'FAILED' GROUP BY 1)
SELECT a.event_id, a.job_id, a.outcome, coalesce(CASE WHEN m.event_id IS NOT NULL THEN measured END, a.inference_ms) AS inference_ms, m.event_id IS NOT NULL AND measured IS NOT NULL AS corrected
FROM attempts a LEFT JOIN made m ON a.event_id = m.event_id LEFT JOIN late l ON a.job_id = l.job_id"""),
)
def st07_late_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measurement that arrives late replaces, once, the row made up when the lease expired; rows that were measured stay."""
    u = usage(spark, sf_dir)
    late = u.where("outcome = 'SUCCEEDED' AND event_id % 3 = 0").groupBy("job_id").agg(F.max_by("inference_ms", "event_id").alias("measured"))
    made = u.where("outcome = 'FAILED'").groupBy("job_id").agg(F.max("event_id").alias("event_id")).withColumn("made", F.lit(True))
    whole = u.join(made, ["job_id", "event_id"], "left").join(late, "job_id", "left")
    corrected = F.coalesce("made", F.lit(False)) & F.col("measured").isNotNull()
    return whole.select("event_id", "job_id", "outcome", F.when(corrected, F.col("measured")).otherwise(F.col("inference_ms")).alias("inference_ms"), corrected.alias("corrected"))


@register(
    "st08_expired_leases",
    oracle(f"""
, n AS (SELECT max(created_at) AS now FROM calls)
SELECT call_id, CASE WHEN state <> 'P' THEN 'untouched' WHEN created_at + to_seconds(duration_seconds + {GRACE_S}) > now THEN 'running' WHEN critical THEN 'cancelled' WHEN version >= {MAX_ATTEMPTS} THEN 'failed' ELSE 'queued' END AS outcome,
  CASE WHEN state = 'P' AND created_at + to_seconds(duration_seconds + {GRACE_S}) <= now AND NOT critical AND version < {MAX_ATTEMPTS} THEN least({MAX_BACKOFF_S}, {BACKOFF_S} * CAST(power(2, version - 1) AS BIGINT)) END AS wait_s
FROM calls, n"""),
)
def st08_expired_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs whose lease and its grace have passed: cancelled if that was asked, failed after the last attempt, else queued again after a doubling wait."""
    c = calls(spark, sf_dir)
    now = F.broadcast(c.agg(F.max("created_at").alias("now")))
    over = F.col("created_at") + F.make_dt_interval(secs=F.col("duration_seconds") + GRACE_S) <= F.col("now")
    outcome = F.when(F.col("state") != "P", "untouched").when(~over, "running").when(F.col("critical"), "cancelled").when(F.col("version") >= MAX_ATTEMPTS, "failed").otherwise("queued")
    wait = F.least(F.lit(MAX_BACKOFF_S).cast("bigint"), F.lit(BACKOFF_S) * F.pow(F.lit(2), F.col("version") - 1).cast("bigint"))
    return c.join(now).select("call_id", outcome.alias("outcome"), F.when(outcome == "queued", wait).alias("wait_s"))


@register(
    "st11_new_alerts",
    oracle("""
, m AS (SELECT DISTINCT call_id, version, category_id FROM hits WHERE confidence_pct >= 60)
SELECT m.call_id, m.version, m.category_id FROM m WHERE NOT EXISTS (SELECT 1 FROM m p WHERE p.call_id = m.call_id AND p.category_id = m.category_id AND p.version = m.version - 1)"""),
)
def st11_new_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that match a call's version and did not match the version before."""
    matched = hits(spark, sf_dir).where("confidence_pct >= 60").select("call_id", "version", "category_id").distinct()
    before = matched.withColumn("version", F.col("version") + 1)
    return matched.join(before, ["call_id", "version", "category_id"], "left_anti")


@register(
    "st12_merged_requests",
    oracle("SELECT agent_id, version, count(*) AS asked, max(score_tenths) AS priority, bool_or(critical) AS forced, min(created_at) AS since FROM calls WHERE requires_review GROUP BY 1, 2"),
)
def st12_merged_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pending request for each artifact: later ones raise its priority and widen its flags."""
    asked = calls(spark, sf_dir).where("requires_review")
    return asked.groupBy("agent_id", "version").agg(F.count("*").alias("asked"), F.max("score_tenths").alias("priority"), F.bool_or("critical").alias("forced"), F.min("created_at").alias("since"))


@register(
    "st14_flushed_changes",
    oracle("""
, t AS (SELECT event_id // 100 AS batch, job_id, min(event_id) AS first_touch, max(event_id) AS last_touch, count(*) AS touches FROM attempts GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY batch ORDER BY first_touch) AS place FROM t"""),
)
def st14_flushed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touches of a resource inside one transaction collapse into one change; changes are flushed in the order of first touches."""
    t = usage(spark, sf_dir).groupBy(F.expr("event_id div 100").alias("batch"), "job_id").agg(F.min("event_id").alias("first_touch"), F.max("event_id").alias("last_touch"), F.count("*").alias("touches"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("first_touch")))


@register(
    "flt08_rules_with_fields",
    oracle("""
, rules AS (SELECT n_nationkey AS rule_id, n_nationkey % 6 AS category_id, n_regionkey * 20 AS min_pct, CASE n_nationkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'R' ELSE 'N' END AS field_equals FROM nation)
SELECT rule_id, count(DISTINCT h.call_id) AS calls FROM rules r JOIN hits h ON h.category_id = r.category_id AND h.confidence_pct >= r.min_pct
WHERE EXISTS (SELECT 1 FROM lineitem f WHERE f.l_orderkey = h.call_id AND f.l_linenumber = h.turn_id AND f.l_partkey = h.hit_key AND f.l_returnflag = r.field_equals) GROUP BY 1"""),
)
def flt08_rules_with_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that have, for a rule, a hit of its category and confidence one of whose fields equals the rule's value."""
    n = F.col("n_nationkey")
    rules = table(spark, sf_dir, "nation").select(n.alias("rule_id"), (n % 6).alias("category_id"), (F.col("n_regionkey") * 20).alias("min_pct"), F.when(n % 3 == 0, "A").when(n % 3 == 1, "R").otherwise("N").alias("field_equals"))
    fields = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").cast("bigint").alias("turn_id"), F.col("l_partkey").alias("hit_key"), F.col("l_returnflag").alias("field_equals"))
    met = hits(spark, sf_dir).join(F.broadcast(rules), "category_id").where("confidence_pct >= min_pct")
    return met.join(fields, ["call_id", "turn_id", "hit_key", "field_equals"], "left_semi").groupBy("rule_id").agg(F.countDistinct("call_id").alias("calls"))


@register("flt13_read_default", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'draft') AS status FROM orders")
def flt13_read_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unset status reads as the default."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("draft")).alias("status"))


@register("src02_snapshot", "SELECT user_id, count(*) AS events, count(*) * 100.0 / (SELECT count(*) FROM events) AS share_pct FROM events GROUP BY 1")
def src02_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two statements over one written snapshot agree, whatever is appended to the source in between."""
    snapshot = materialise(table(spark, sf_dir, "events").select("user_id"), "snapshot")
    whole = snapshot.agg(F.count("*").alias("whole"))
    per = snapshot.groupBy("user_id").agg(F.count("*").alias("events"))
    return per.join(F.broadcast(whole)).select("user_id", "events", (F.col("events") * 100 / F.col("whole")).alias("share_pct"))


@register("src03_read_by_content", "SELECT event_id, sha256(props) AS checksum, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def src03_read_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows hold a checksum, objects are stored once by theirs and read as a typed document."""
    e = table(spark, sf_dir, "events").withColumn("checksum", F.sha2("props", 256))
    objects = e.select("checksum", "props").dropDuplicates(["checksum"]).select("checksum", F.from_json("props", "k bigint").alias("doc"))
    return e.select("event_id", "checksum").join(objects, "checksum").select("event_id", "checksum", F.col("doc.k").alias("k"))


@register("src05_file_digests")
def src05_file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as rows with their length and digest."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/region.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


#: Integers beyond this have no exact double.
EXACT = 2**53


def _number(x: int | float) -> str:
    """A number as RFC 8785 writes it: the shortest digits of the double, plain from 1e-6 to below 1e21."""
    if isinstance(x, int):
        if abs(x) > EXACT:
            raise ValueError("an integer beyond 2^53 is not exact")
        return str(x)
    if not math.isfinite(x):
        raise ValueError("JSON has no such number")
    shortest = Decimal(repr(x)).normalize()
    return "0" if x == 0 else format(shortest, "f" if 1e-6 <= abs(x) < 1e21 else "e")


def canonical_json(value: object) -> str:
    """RFC 8785: keys sorted by UTF-16 units, no blanks, one form of each number and text. What has none, as a lone surrogate, is a ValueError."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return _number(value)
    out = json.dumps(value, ensure_ascii=False)
    out.encode()
    return out


def canonical_digest(text: Column) -> Column:
    """SHA-256 of a JSON text's canonical form; null for what is no JSON, has no canonical form, or is nested too deeply to read."""

    def one(t: str | None) -> str | None:
        try:
            return canonical_json(json.loads(t)) if t is not None else None
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return F.sha2(canonical(text), 256)


@register("fn21_canonical_digest", r"""SELECT event_id, sha256('{"a":[1,2.5,0.00001,1e-7],"k":' || json_extract_string(props, '$.k') || ',"v":' || regexp_replace(CAST(value AS VARCHAR), '\.0$', '') || '}') AS digest FROM events""")
def fn21_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.concat(F.lit('{ "v":'), F.col("value").cast("string"), F.lit(', "k" : '), F.get_json_object("props", "$.k"), F.lit(', "a" : [1.0, 2.50, 1e-5, 1E-7] }'))
    return table(spark, sf_dir, "events").select("event_id", canonical_digest(wide).alias("digest"))
