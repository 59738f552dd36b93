"""The tables that operators read, and the call-analytics entities derived from them.

An entity has one DataFrame function here and one SQL text (`SQL`), a chain of common table
expressions with the same rows, for the oracle queries. Scores are kept as whole tenths, so
that sums do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per call: agent, time, duration, score in tenths and the flags of its evaluation."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("call_id"),
        F.col("o_custkey").alias("agent_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("state"),
        F.col("o_orderpriority").alias("stream"),
        (k % 1800 + 30).alias("duration_seconds"),
        (k * 37 % 1001).alias("score_tenths"),
        (k % 5 == 0).alias("requires_review"),
        (k % 11 == 0).alias("critical"),
        (k % 3 + 1).alias("version"),
    )


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; ties are the caller's to break."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest verdict of each call and criterion."""
    li = table(spark, sf_dir, "lineitem")
    status = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "PASS").when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_linestatus") == "F", "FLAGGED").when(F.col("l_partkey") % 9 == 0, "NOT_APPLICABLE").otherwise("PASS")
    rows = li.select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("criterion_id"), status.alias("status"), F.col("l_quantity").cast("bigint").alias("weight"), (F.col("l_partkey") * 7 % 101).alias("confidence_pct"), "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    newest = [F.col(c).desc() for c in ("l_shipdate", "l_partkey", "l_suppkey", "weight", "l_extendedprice")] + [F.col("status")]
    return latest(rows, ["call_id", "criterion_id"], newest).select("call_id", "criterion_id", "status", "weight", "confidence_pct")


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of human verdicts: some calls' criteria, several reviews of some."""
    v = verdicts(spark, sf_dir).where("(call_id + criterion_id) % 13 < 3")
    turned = F.when(F.col("status") == "PASS", "FAIL").otherwise("PASS")
    return v.withColumn("review_version", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("call_id") % 3 + 1))).select("call_id", "criterion_id", "review_version", F.when((F.col("review_version") + F.col("criterion_id")) % 2 == 0, turned).otherwise(F.col("status")).alias("human_status"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal hits: category, subcategory, speaker, time in the call and confidence; of the call's current version or an older one."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("call_id"),
        (F.col("l_suppkey") % 3 + 1).alias("version"),
        (F.col("l_partkey") % 6).alias("category_id"),
        (F.col("l_partkey") % 18).alias("subcategory_id"),
        F.when(F.col("l_linenumber") % 2 == 0, "AGENT").otherwise("CALLER").alias("speaker"),
        F.col("l_linenumber").cast("bigint").alias("turn_id"),
        (F.col("l_linenumber").cast("bigint") * 12 + F.col("l_suppkey") % 7).alias("start_s"),
        (F.col("l_linenumber").cast("bigint") * 12 + F.col("l_suppkey") % 7 + F.col("l_quantity").cast("bigint") % 15).alias("end_s"),
        (F.col("l_partkey") * 13 % 101).alias("confidence_pct"),
        F.col("l_partkey").alias("hit_key"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per attempt: route, model, outcome, tokens and seconds; tokens may be missing."""
    e = table(spark, sf_dir, "events")
    n = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        "event_id",
        F.col("ts").alias("recorded_at"),
        F.col("user_id").alias("job_id"),
        F.col("event_type").alias("route_class"),
        F.when(n % 5 != 0, F.concat(F.lit("m"), (n % 5).cast("string"))).alias("model"),
        F.when(F.col("event_id") % 10 == 0, "FAILED").when(F.col("event_id") % 17 == 0, "REJECTED").otherwise("SUCCEEDED").alias("outcome"),
        F.when(F.col("event_id") % 4 != 0, n * 10).alias("tokens_input"),
        (F.col("event_id") % 97).alias("wait_ms"),
        (F.col("event_id") * 31 % 1009).alias("inference_ms"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript turns with speakers; a turn lasts as long as its words take at 2.4 a second, in tenths of seconds."""
    c = table(spark, sf_dir, "conversations")
    words = F.size(F.split(F.trim("text"), " +")).cast("bigint")
    length = F.floor(words * 25 / 6)
    by = Window.partitionBy("conv_id").orderBy("turn")
    speaker = F.when(F.col("role") == "user", "CALLER").when(F.col("role") == "assistant", "AGENT").when(F.col("role") == "system", "SYSTEM").otherwise("UNKNOWN")
    rows = c.select("conv_id", "turn", speaker.alias("speaker"), "text", words.alias("words"), length.alias("length"))
    end = F.sum("length").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("conv_id", "turn", "speaker", "text", "words", (end - F.col("length")).alias("start_ds"), end.alias("end_ds"))


#: The same entities for the oracle, as common table expressions.
SQL = """
calls AS (
  SELECT o_orderkey AS call_id, o_custkey AS agent_id, o_orderdate AS created_at, o_orderstatus AS state, o_orderpriority AS stream,
    o_orderkey % 1800 + 30 AS duration_seconds, o_orderkey * 37 % 1001 AS score_tenths, o_orderkey % 5 = 0 AS requires_review, o_orderkey % 11 = 0 AS critical, o_orderkey % 3 + 1 AS version
  FROM orders
), verdict_log AS (
  SELECT l_orderkey AS call_id, l_linenumber AS criterion_id,
    CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'PASS' WHEN l_returnflag = 'R' THEN 'FAIL' WHEN l_linestatus = 'F' THEN 'FLAGGED' WHEN l_partkey % 9 = 0 THEN 'NOT_APPLICABLE' ELSE 'PASS' END AS status,
    CAST(trunc(l_quantity) AS BIGINT) AS weight, l_partkey * 7 % 101 AS confidence_pct, l_shipdate, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem
), verdicts AS (
  SELECT call_id, criterion_id, status, weight, confidence_pct FROM verdict_log
  QUALIFY row_number() OVER (PARTITION BY call_id, criterion_id ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, weight DESC, l_extendedprice DESC, status) = 1
), overrides AS (
  SELECT call_id, criterion_id, review_version,
    CASE WHEN (review_version + criterion_id) % 2 = 0 THEN CASE WHEN status = 'PASS' THEN 'FAIL' ELSE 'PASS' END ELSE status END AS human_status
  FROM (SELECT *, unnest(range(1, call_id % 3 + 2)) AS review_version FROM verdicts WHERE (call_id + criterion_id) % 13 < 3)
), hits AS (
  SELECT l_orderkey AS call_id, l_suppkey % 3 + 1 AS version, l_partkey % 6 AS category_id, l_partkey % 18 AS subcategory_id,
    CASE WHEN l_linenumber % 2 = 0 THEN 'AGENT' ELSE 'CALLER' END AS speaker, CAST(l_linenumber AS BIGINT) AS turn_id,
    CAST(l_linenumber AS BIGINT) * 12 + l_suppkey % 7 AS start_s, CAST(l_linenumber AS BIGINT) * 12 + l_suppkey % 7 + CAST(trunc(l_quantity) AS BIGINT) % 15 AS end_s,
    l_partkey * 13 % 101 AS confidence_pct, l_partkey AS hit_key
  FROM lineitem
), attempts AS (
  SELECT event_id, ts AS recorded_at, user_id AS job_id, event_type AS route_class, n,
    CASE WHEN n % 5 <> 0 THEN 'm' || (n % 5) END AS model,
    CASE WHEN event_id % 10 = 0 THEN 'FAILED' WHEN event_id % 17 = 0 THEN 'REJECTED' ELSE 'SUCCEEDED' END AS outcome,
    CASE WHEN event_id % 4 <> 0 THEN n * 10 END AS tokens_input, event_id % 97 AS wait_ms, event_id * 31 % 1009 AS inference_ms
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events)
), turn_words AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'CALLER' WHEN 'assistant' THEN 'AGENT' WHEN 'system' THEN 'SYSTEM' ELSE 'UNKNOWN' END AS speaker, text,
    CAST(len(regexp_split_to_array(trim(text, ' '), ' +')) AS BIGINT) AS words
  FROM conversations
), turns AS (
  SELECT conv_id, turn, speaker, text, words, CAST(sum(words * 25 // 6) OVER w - words * 25 // 6 AS BIGINT) AS start_ds, CAST(sum(words * 25 // 6) OVER w AS BIGINT) AS end_ds
  FROM turn_words WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
)
"""


def oracle(body: str) -> str:
    return f"WITH {SQL.strip()} {body}"
