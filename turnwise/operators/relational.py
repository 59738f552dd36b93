"""Filters, joins, set operations, sorted pages and top-k over the call tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnwise.operators.metrics import current_hits, newest_overrides
from turnwise.registry import register
from turnwise.sources.tables import calls, hits, oracle, overrides, table, turns, usage, verdicts


def all_of(conditions: Sequence[Column | None]) -> Column:
    """Conditions that were supplied, joined by AND; TRUE if none was."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def list_calls(calls: DataFrame, agent: int | None = None, needs_review: bool | None = None, since: str | None = None, before: str | None = None) -> DataFrame:
    """Calls by any of agent, review need and a half-open time range."""
    return calls.where(
        all_of(
            [
                None if agent is None else F.col("agent_id") == agent,
                None if needs_review is None else F.col("requires_review") == needs_review,
                None if since is None else F.col("created_at") >= F.lit(since).cast("timestamp_ntz"),
                None if before is None else F.col("created_at") < F.lit(before).cast("timestamp_ntz"),
            ]
        )
    )


@register("flt01_list_calls", oracle("SELECT * FROM calls WHERE requires_review AND created_at >= TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '1996-01-01'"))
def flt01_list_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_calls(calls(spark, sf_dir), needs_review=True, since="1995-01-01", before="1996-01-01")


@register("flt02_time_window", oracle("SELECT call_id, created_at FROM calls WHERE created_at >= TIMESTAMP '1994-03-01' AND created_at < TIMESTAMP '1994-04-01'"))
def flt02_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_calls(calls(spark, sf_dir), since="1994-03-01", before="1994-04-01").select("call_id", "created_at")


def contains_text(columns: Sequence[str], needle: str) -> Column:
    """Case-insensitive substring in any column; % and _ of the needle are plain characters."""
    pattern = "%" + needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return reduce(lambda a, b: a | b, [F.col(c).ilike(pattern) for c in columns])


@register("flt03_substring_search", "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'al') OR contains(lower(p_type), 'al') OR contains(lower(p_brand), 'al')")
def flt03_substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(contains_text(["p_name", "p_type", "p_brand"], "AL")).select("p_partkey", "p_name", "p_type")


@register("flt05_status_in", oracle("SELECT call_id, criterion_id, status FROM verdicts WHERE status IN ('FAIL', 'FLAGGED')"))
def flt05_status_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).where(F.col("status").isin("FAIL", "FLAGGED")).select("call_id", "criterion_id", "status")


@register("flt06_not_prefix", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT LIKE 'BU%'")
def flt06_not_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(~F.col("c_mktsegment").startswith("BU")).select("c_custkey", "c_mktsegment")


@register("flt07_calls_with_hit", oracle("SELECT call_id FROM calls c WHERE EXISTS (SELECT 1 FROM hits h WHERE h.call_id = c.call_id AND h.version = c.version AND h.category_id = 2)"))
def flt07_calls_with_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).join(hits(spark, sf_dir).where("category_id = 2"), ["call_id", "version"], "left_semi").select("call_id")


@register(
    "flt14_effective_status",
    oracle("SELECT call_id, CASE WHEN state = 'O' AND duration_seconds > 900 THEN 'P' ELSE state END AS effective FROM calls"),
)
def flt14_effective_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim whose lease ran out reads as pending."""
    return calls(spark, sf_dir).select("call_id", F.when((F.col("state") == "O") & (F.col("duration_seconds") > 900), "P").otherwise(F.col("state")).alias("effective"))


def hash_share(key: Column) -> Column:
    """The first 15 hexadecimal digits of the key's SHA-256, as a share of all."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("bigint") / F.lit(1 << 60)


_SHARE = "CAST(CAST('0x' || substr(sha256({}), 1, 15) AS BIGINT) AS DOUBLE) / 1152921504606846976"


@register("flt16_hash_sample", oracle(f"SELECT call_id FROM calls WHERE {_SHARE.format('CAST(call_id AS VARCHAR) || chr(58) || version')} < 0.1"))
def flt16_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the calls, the same ones in every run (a sampling operator)."""
    return calls(spark, sf_dir).where(hash_share(F.concat_ws(":", "call_id", "version")) < 0.1).select("call_id")


def hash_mod_100(key: Column) -> Column:
    """SHA-256 as one integer modulo 100: a fold over its hexadecimal digits."""
    digits = F.transform(F.filter(F.split(F.sha2(key, 256), ""), lambda c: c != ""), lambda c: F.conv(c, 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda a, x: (a * 16 + x) % 100)


@register(
    "flt17_split",
    oracle("""SELECT call_id, CASE WHEN m < 20 THEN 'eval' WHEN m < 30 THEN 'valid' ELSE 'train' END AS split FROM (
SELECT call_id, list_reduce(list_prepend(0, list_transform(string_split(sha256('site:' || call_id), ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS INTEGER))), lambda a, x: (a * 16 + x) % 100) AS m FROM calls)"""),
)
def flt17_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = hash_mod_100(F.concat(F.lit("site:"), F.col("call_id").cast("string")))
    return calls(spark, sf_dir).select("call_id", F.when(m < 20, "eval").when(m < 30, "valid").otherwise("train").alias("split"))


@register("flt18_speaker_scope", oracle("SELECT conv_id, turn, NOT bool_or(speaker = 'UNKNOWN') OVER (PARTITION BY conv_id) AS usable FROM turns QUALIFY speaker = 'CALLER'"))
def flt18_speaker_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caller turns; not usable if any turn of the call has no known speaker."""
    unknown = F.bool_or(F.col("speaker") == "UNKNOWN").over(Window.partitionBy("conv_id"))
    return turns(spark, sf_dir).withColumn("usable", ~unknown).where("speaker = 'CALLER'").select("conv_id", "turn", "usable")


@register(
    "flt19_head_and_tail",
    oracle("SELECT conv_id, turn, start_ds <= 100 AS head, start_ds >= greatest(0, max(end_ds) OVER (PARTITION BY conv_id) - 100) AS tail FROM turns"),
)
def flt19_head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in a call's first and last ten seconds."""
    end = F.max("end_ds").over(Window.partitionBy("conv_id"))
    return turns(spark, sf_dir).select("conv_id", "turn", (F.col("start_ds") <= 100).alias("head"), (F.col("start_ds") >= F.greatest(F.lit(0), end - 100)).alias("tail"))


@register("jn01_calls_and_agents", oracle("SELECT call_id, c_name, n_name, r_name FROM calls JOIN customer ON agent_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"))
def jn01_calls_and_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their dimensions; nations and regions are fixed, tiny tables, so they are broadcast."""
    t = lambda name: table(spark, sf_dir, name)
    places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    agents = t("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return calls(spark, sf_dir).join(agents, F.col("agent_id") == F.col("c_custkey")).select("call_id", "c_name", "n_name", "r_name")


@register("jn02_current_hits", oracle("SELECT h.call_id, h.hit_key, h.turn_id, c.agent_id FROM hits h JOIN calls c USING (call_id, version)"))
def jn02_current_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_hits(hits(spark, sf_dir), calls(spark, sf_dir)).select("call_id", "hit_key", "turn_id", "agent_id")


@register("jn04_calls_without_verdict", oracle("SELECT call_id FROM calls c WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.call_id = c.call_id)"))
def jn04_calls_without_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).join(table(spark, sf_dir, "lineitem"), F.col("call_id") == F.col("l_orderkey"), "left_anti").select("call_id")


@register("jn05_agents_with_calls", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def jn05_agents_with_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@register("jn06_effective_verdicts", oracle("SELECT call_id, criterion_id, coalesce((SELECT max_by(human_status, review_version) FROM overrides o WHERE o.call_id = v.call_id AND o.criterion_id = v.criterion_id), status) AS status FROM verdicts v"))
def jn06_effective_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest human verdict, or the machine's: one aggregated join in place of a subquery per row."""
    newest = overrides(spark, sf_dir).groupBy("call_id", "criterion_id").agg(F.max_by("human_status", "review_version").alias("human"))
    return verdicts(spark, sf_dir).join(newest, ["call_id", "criterion_id"], "left").select("call_id", "criterion_id", F.coalesce("human", "status").alias("status"))


@register("jn07_newest_of_agent", oracle("SELECT agent_id, max_by(call_id, (created_at, call_id)) AS call_id, max(created_at) AS created_at FROM calls GROUP BY 1"))
def jn07_newest_of_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).groupBy("agent_id").agg(F.max(F.struct("created_at", "call_id")).alias("m")).select("agent_id", "m.call_id", "m.created_at")


@register("jn08_not_projected", oracle("SELECT call_id, version, coalesce(seen, -1) AS seen FROM calls LEFT JOIN (SELECT call_id, max(version) AS seen FROM hits GROUP BY 1) USING (call_id) WHERE coalesce(seen, -1) < version"))
def jn08_not_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose newest version has not been projected yet."""
    seen = hits(spark, sf_dir).groupBy("call_id").agg(F.max("version").alias("seen"))
    return calls(spark, sf_dir).join(seen, "call_id", "left").select("call_id", "version", F.coalesce("seen", F.lit(-1)).alias("seen")).where("seen < version")


@register("jn11_attribution_overlay", oracle("SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 = 0 THEN 'AGENT' ELSE speaker END AS speaker FROM turns"))
def jn11_attribution_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assigned speakers replace the found ones; turns without an assignment keep theirs."""
    t = turns(spark, sf_dir)
    assigned = t.where("(conv_id + turn) % 4 = 0").select("conv_id", "turn", F.lit("AGENT").alias("assigned"))
    return t.join(assigned, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("assigned", "speaker").alias("speaker"))


@register(
    "jn13_blocks_and_turns",
    oracle("SELECT t.conv_id, b.block, t.turn, least(t.end_ds, b.block * 70 + 70) - greatest(t.start_ds, b.block * 70) AS shared_ds FROM turns t, (SELECT conv_id, unnest(range(0, (max(end_ds) + 69) // 70)) AS block FROM turns GROUP BY 1) b WHERE t.conv_id = b.conv_id AND t.start_ds < b.block * 70 + 70 AND t.end_ds > b.block * 70"),
)
def jn13_blocks_and_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """7-second blocks and the turns that overlap them: a turn is dealt to its blocks, no range join is needed."""
    t = turns(spark, sf_dir).where("end_ds > start_ds")
    met = t.withColumn("block", F.explode(F.expr("sequence(start_ds div 70, (end_ds - 1) div 70)")))
    return met.select("conv_id", "block", "turn", (F.least("end_ds", F.col("block") * 70 + 70) - F.greatest("start_ds", F.col("block") * 70)).alias("shared_ds"))


@register(
    "jn14_overtalk",
    oracle("SELECT a.call_id, CAST(sum(least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)) AS BIGINT) AS overtalk_s FROM hits a JOIN hits b ON a.call_id = b.call_id AND a.speaker = 'AGENT' AND b.speaker = 'CALLER' AND a.start_s < b.end_s AND b.start_s < a.end_s GROUP BY 1"),
)
def jn14_overtalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds in which both speakers' intervals overlap, per call; intervals meet inside a call only."""
    h = hits(spark, sf_dir)
    a = h.where("speaker = 'AGENT'").select("call_id", F.col("start_s").alias("s1"), F.col("end_s").alias("e1"))
    b = h.where("speaker = 'CALLER'").select("call_id", F.col("start_s").alias("s2"), F.col("end_s").alias("e2"))
    return a.join(b, "call_id").where("s1 < e2 AND s2 < e1").groupBy("call_id").agg(F.sum(F.least("e1", "e2") - F.greatest("s1", "s2")).alias("overtalk_s"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: Sequence[str]) -> DataFrame:
    """For each left row the newest right row of its key at or before it: one union, one window, no range join."""
    marked = left.withColumn("_side", F.lit(1)).unionByName(right.select(key, at, F.struct(*values).alias("_found")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    seen = F.last("_found", ignorenulls=True).over(Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_seen", seen).where("_side = 1").select(*left.columns, *[F.col(f"_seen.{v}").alias(v) for v in values])


@register(
    "jn17_as_of",
    """WITH p AS (SELECT user_id, ts, max(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.event_id, p.purchase_id FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""",
)
def jn17_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase_id"))
    return as_of(e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", ["purchase_id"]).select("event_id", "purchase_id")


@register(
    "jn22_version_diff",
    oracle("""
, a AS (SELECT call_id, turn_id, min(category_id) AS c FROM hits WHERE version = 1 GROUP BY 1, 2), b AS (SELECT call_id, turn_id, min(category_id) AS c FROM hits WHERE version = 2 GROUP BY 1, 2)
SELECT coalesce(a.call_id, b.call_id) AS call_id, coalesce(a.turn_id, b.turn_id) AS turn_id, CASE WHEN a.call_id IS NULL THEN 'added' WHEN b.call_id IS NULL THEN 'removed' WHEN a.c <> b.c THEN 'relabelled' ELSE 'same' END AS change
FROM a FULL JOIN b ON a.call_id = b.call_id AND a.turn_id = b.turn_id"""),
)
def jn22_version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda v, name: hits(spark, sf_dir).where(F.col("version") == v).groupBy("call_id", "turn_id").agg(F.min("category_id").alias(name))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "relabelled").otherwise("same")
    return of(1, "old").join(of(2, "new"), ["call_id", "turn_id"], "full").select("call_id", "turn_id", change.alias("change"))


@register("jn25_backfill_candidates", oracle("SELECT call_id, created_at, version < 3 AS needs_update FROM calls WHERE EXISTS (SELECT 1 FROM hits h WHERE h.call_id = calls.call_id) ORDER BY created_at DESC, call_id DESC LIMIT 50"))
def jn25_backfill_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest calls with a result (a page of 50)."""
    return calls(spark, sf_dir).join(hits(spark, sf_dir), "call_id", "left_semi").orderBy(F.desc("created_at"), F.desc("call_id")).limit(50).select("call_id", "created_at", (F.col("version") < 3).alias("needs_update"))


@register(
    "jn26_group_stakes",
    oracle("SELECT agent_id, stream, count(*) AS jobs, max_by(state, (created_at, call_id)) AS newest_state, max_by(call_id, (created_at, call_id)) FILTER (state = 'F') AS newest_failed FROM calls GROUP BY 1, 2"),
)
def jn26_group_stakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("created_at", "call_id")
    return calls(spark, sf_dir).groupBy("agent_id", "stream").agg(F.count("*").alias("jobs"), F.max_by("state", order).alias("newest_state"), F.max_by(F.when(F.col("state") == "F", F.col("call_id")), F.when(F.col("state") == "F", order)).alias("newest_failed"))


@register("srt01_mixed_order", oracle("SELECT call_id, row_number() OVER (PARTITION BY agent_id ORDER BY created_at DESC NULLS LAST, call_id DESC NULLS LAST) AS place FROM calls"))
def srt01_mixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("call_id", F.row_number().over(Window.partitionBy("agent_id").orderBy(F.desc("created_at"), F.desc("call_id"))).alias("place"))


def keyset_page(df: DataFrame, keys: Sequence[tuple[str, bool]], after: Sequence[Column] | None, size: int) -> DataFrame:
    """Rows after a key in mixed order (name, descending?), one more than `size` to tell whether another page follows."""
    if after is not None:
        condition, equal = F.lit(False), F.lit(True)
        for (name, down), value in zip(keys, after, strict=True):
            condition = condition | (equal & (F.col(name) < value if down else F.col(name) > value))
            equal = equal & (F.col(name) == value)
        df = df.where(condition)
    return df.orderBy(*[F.desc(n) if down else F.asc(n) for n, down in keys]).limit(size + 1)


@register(
    "srt02_keyset_page",
    oracle("SELECT call_id, created_at, to_base64(encode(strftime(created_at, '%Y-%m-%d') || '|' || call_id)) AS token FROM calls WHERE created_at < TIMESTAMP '1996-06-01' OR (created_at = TIMESTAMP '1996-06-01' AND call_id < 5000) ORDER BY created_at DESC, call_id DESC LIMIT 26"),
)
def srt02_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = keyset_page(calls(spark, sf_dir), [("created_at", True), ("call_id", True)], [F.lit("1996-06-01").cast("timestamp_ntz"), F.lit(5000)], 25)
    return page.select("call_id", "created_at", F.base64(F.concat_ws("|", F.date_format("created_at", "yyyy-MM-dd"), F.col("call_id").cast("string")).cast("binary")).alias("token"))


@register(
    "srt03_keyset_three_keys",
    oracle("SELECT call_id, stream, created_at FROM calls WHERE stream < '3-MEDIUM' OR (stream = '3-MEDIUM' AND created_at > TIMESTAMP '1995-01-01') OR (stream = '3-MEDIUM' AND created_at = TIMESTAMP '1995-01-01' AND call_id > 10) ORDER BY stream DESC, created_at, call_id LIMIT 21"),
)
def srt03_keyset_three_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyset_page(calls(spark, sf_dir), [("stream", True), ("created_at", False), ("call_id", False)], [F.lit("3-MEDIUM"), F.lit("1995-01-01").cast("timestamp_ntz"), F.lit(10)], 20).select("call_id", "stream", "created_at")


@register("srt05_most_urgent", oracle("SELECT call_id FROM calls WHERE requires_review AND state = 'O' ORDER BY CASE WHEN critical THEN 60 ELSE 0 END + greatest(0, 1000 - score_tenths) / 100 DESC, created_at, call_id LIMIT 1"))
def srt05_most_urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgency = F.when(F.col("critical"), 60).otherwise(0) + F.greatest(F.lit(0), 1000 - F.col("score_tenths")) / 100
    return calls(spark, sf_dir).where("requires_review AND state = 'O'").orderBy(urgency.desc(), "created_at", "call_id").limit(1).select("call_id")


@register(
    "srt07_capacity_claim",
    oracle("SELECT call_id, stream, slot FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY critical DESC, created_at, call_id) AS slot FROM calls WHERE state = 'O') WHERE slot <= CAST(left(stream, 1) AS INTEGER) * 2"),
)
def srt07_capacity_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each slot takes its first jobs in claim order, up to its capacity (the feature here)."""
    slot = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("critical"), "created_at", "call_id"))
    return calls(spark, sf_dir).where("state = 'O'").withColumn("slot", slot).where(F.col("slot") <= F.substring("stream", 1, 1).cast("int") * 2).select("call_id", "stream", "slot")


@register("set01_union_distinct", oracle("SELECT call_id, turn_id FROM hits WHERE category_id = 0 UNION SELECT call_id, turn_id FROM hits WHERE category_id = 2"))
def set01_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    return h.where("category_id = 0").select("call_id", "turn_id").unionByName(h.where("category_id = 2").select("call_id", "turn_id")).distinct()


@register("set02_union_in_order", oracle("SELECT call_id, source, row_number() OVER (PARTITION BY call_id ORDER BY source, k) AS place FROM (SELECT call_id, 1 AS source, criterion_id AS k FROM verdicts UNION ALL SELECT call_id, 2, criterion_id * 10 + review_version FROM overrides)"))
def set02_union_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = verdicts(spark, sf_dir).select("call_id", F.lit(1).alias("source"), F.col("criterion_id").cast("bigint").alias("k"))
    b = overrides(spark, sf_dir).select("call_id", F.lit(2).alias("source"), (F.col("criterion_id") * 10 + F.col("review_version")).alias("k"))
    return a.unionByName(b).select("call_id", "source", F.row_number().over(Window.partitionBy("call_id").orderBy("source", "k")).alias("place"))


@register("set03_newly_fired", oracle("SELECT call_id, category_id FROM hits WHERE version = 2 EXCEPT SELECT call_id, category_id FROM hits WHERE version = 1"))
def set03_newly_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    return h.where("version = 2").select("call_id", "category_id").subtract(h.where("version = 1").select("call_id", "category_id"))


@register("set04_intersection", oracle("SELECT call_id, category_id FROM hits WHERE version = 2 INTERSECT SELECT call_id, category_id FROM hits WHERE version = 1"))
def set04_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    return h.where("version = 2").select("call_id", "category_id").intersect(h.where("version = 1").select("call_id", "category_id"))


@register("set05_subset", oracle("SELECT call_id, list_has_all(list(DISTINCT status), ['PASS', 'FAIL']) AS has_both FROM verdicts GROUP BY 1"))
def set05_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(F.lit("PASS"), F.lit("FAIL"))
    return verdicts(spark, sf_dir).groupBy("call_id").agg((F.size(F.array_except(wanted, F.collect_set("status"))) == 0).alias("has_both"))


@register(
    "set06_effective_vocabulary",
    """WITH v AS (SELECT p_name AS term, 1 AS pack, p_partkey AS k FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT upper(p_name), 2, p_partkey FROM part WHERE p_partkey % 3 = 0)
SELECT term, pack FROM v QUALIFY row_number() OVER (PARTITION BY lower(term) ORDER BY pack, k) = 1""",
)
def set06_effective_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack's terms without disabled ones, then a customer's that are new, by normalised term."""
    p = table(spark, sf_dir, "part")
    both = p.where("p_partkey % 5 <> 0").select(F.col("p_name").alias("term"), F.lit(1).alias("pack"), "p_partkey").unionByName(p.where("p_partkey % 3 = 0").select(F.upper("p_name").alias("term"), F.lit(2).alias("pack"), "p_partkey"))
    return both.withColumn("nth", F.row_number().over(Window.partitionBy(F.lower("term")).orderBy("pack", "p_partkey"))).where("nth = 1").select("term", "pack")


@register("fn27_version_check", oracle("SELECT call_id, review_version AS expected, version AS current, review_version = version AS accepted FROM overrides JOIN calls USING (call_id)"))
def fn27_version_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimistic concurrency: a write names the version that it saw."""
    return overrides(spark, sf_dir).join(calls(spark, sf_dir).select("call_id", "version"), "call_id").select("call_id", F.col("review_version").alias("expected"), F.col("version").alias("current"), (F.col("review_version") == F.col("version")).alias("accepted"))


@register("flt04_unassigned", oracle("SELECT call_id FROM (SELECT c.call_id, o.v, c.version FROM calls c LEFT JOIN (SELECT call_id, max(review_version) AS v FROM overrides GROUP BY 1) o USING (call_id)) WHERE v IS NULL OR NOT (v < version)"))
def flt04_unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Never reviewed, or not stale."""
    seen = overrides(spark, sf_dir).groupBy("call_id").agg(F.max("review_version").alias("v"))
    return calls(spark, sf_dir).join(seen, "call_id", "left").where("v IS NULL OR NOT (v < version)").select("call_id")


@register("flt12_list_items", oracle("SELECT c.call_id, c.state, coalesce(n, 0) AS n_hits, coalesce(r, 0) AS reviews, CAST(score_tenths AS DOUBLE) / 10 AS score FROM calls c LEFT JOIN (SELECT call_id, version, count(*) AS n FROM hits GROUP BY 1, 2) h USING (call_id, version) LEFT JOIN (SELECT call_id, count(*) AS r FROM overrides GROUP BY 1) o ON o.call_id = c.call_id"))
def flt12_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a list of calls shows: facts, hits of the current version and reviews, with defaults where there are none."""
    n = hits(spark, sf_dir).groupBy("call_id", "version").agg(F.count("*").alias("n"))
    r = overrides(spark, sf_dir).groupBy("call_id").agg(F.count("*").alias("r"))
    both = calls(spark, sf_dir).join(n, ["call_id", "version"], "left").join(r, "call_id", "left")
    return both.select("call_id", "state", F.coalesce("n", F.lit(0)).alias("n_hits"), F.coalesce("r", F.lit(0)).alias("reviews"), (F.col("score_tenths").cast("double") / 10).alias("score"))


@register("flt15_audience", oracle("SELECT call_id, category_id FROM hits JOIN (VALUES (0), (2), (4)) g(category_id) USING (category_id) WHERE category_id IN (2, 4, 5)"))
def flt15_audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds that a reader is granted, among those asked for."""
    granted = spark.createDataFrame([(0,), (2,), (4,)], "category_id bigint")
    return hits(spark, sf_dir).where(F.col("category_id").isin(2, 4, 5)).join(F.broadcast(granted), "category_id").select("call_id", "category_id")


@register("flt20_turn_window", oracle("SELECT conv_id, turn, text FROM turns WHERE turn BETWEEN 1 AND 3"))
def flt20_turn_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).where(F.col("turn").between(1, 3)).select("conv_id", "turn", "text")


@register("jn03_jobs_and_requests", oracle("SELECT c.call_id, c.stream, o.human_status FROM calls c LEFT JOIN overrides o ON c.call_id = o.call_id AND o.criterion_id = 1 AND o.review_version = 1"))
def jn03_jobs_and_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = overrides(spark, sf_dir).where("criterion_id = 1 AND review_version = 1").select("call_id", "human_status")
    return calls(spark, sf_dir).join(asked, "call_id", "left").select("call_id", "stream", "human_status")


@register("jn09_names", oracle("SELECT h.call_id, h.hit_key, coalesce(n.name, 'UNKNOWN') AS category FROM hits h LEFT JOIN (VALUES (0, 'billing'), (2, 'delivery')) n(id, name) ON h.category_id = n.id"))
def jn09_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small dictionary joined to facts; what it lacks is UNKNOWN."""
    names = spark.createDataFrame([(0, "billing"), (2, "delivery")], "category_id bigint, name string")
    return hits(spark, sf_dir).join(F.broadcast(names), "category_id", "left").select("call_id", "hit_key", F.coalesce("name", F.lit("UNKNOWN")).alias("category"))


@register("jn12_cluster_correction", oracle("SELECT conv_id, turn, CASE WHEN speaker = first_value(speaker) OVER (PARTITION BY conv_id ORDER BY turn) THEN 'AGENT' ELSE speaker END AS speaker FROM turns"))
def jn12_cluster_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn is relabelled, and with it all turns of its cluster."""
    t = turns(spark, sf_dir)
    fixed = t.groupBy("conv_id").agg(F.min_by("speaker", "turn").alias("cluster"))
    return t.join(fixed, "conv_id").select("conv_id", "turn", F.when(F.col("speaker") == F.col("cluster"), "AGENT").otherwise(F.col("speaker")).alias("speaker"))


@register("jn18_as_of_version", oracle("SELECT o.call_id, o.criterion_id, o.review_version, max(h.version) AS hits_version FROM overrides o LEFT JOIN (SELECT DISTINCT call_id, version FROM hits) h ON o.call_id = h.call_id AND h.version <= o.review_version GROUP BY 1, 2, 3"))
def jn18_as_of_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of a call's hits that is not after a review."""
    h = hits(spark, sf_dir).select("call_id", "version").distinct()
    o = overrides(spark, sf_dir)
    return o.join(h, (o["call_id"] == h["call_id"]) & (h["version"] <= o["review_version"]), "left").groupBy(o["call_id"], "criterion_id", "review_version").agg(F.max("version").alias("hits_version"))


@register("jn23_provenance", oracle("SELECT o.call_id, o.criterion_id, v.status, c.agent_id, h.n IS NOT NULL AS has_hits FROM overrides o JOIN verdicts v USING (call_id, criterion_id) JOIN calls c ON c.call_id = o.call_id LEFT JOIN (SELECT call_id, version, count(*) AS n FROM hits GROUP BY 1, 2) h ON h.call_id = c.call_id AND h.version = c.version WHERE o.review_version = 1"))
def jn23_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a label to the verdict it judges, its call, and the inputs of that."""
    inputs = hits(spark, sf_dir).select("call_id", "version").distinct().withColumn("has", F.lit(True))
    chain = overrides(spark, sf_dir).where("review_version = 1").join(verdicts(spark, sf_dir), ["call_id", "criterion_id"]).join(calls(spark, sf_dir).select("call_id", "agent_id", "version"), "call_id").join(inputs, ["call_id", "version"], "left")
    return chain.select("call_id", "criterion_id", "status", "agent_id", F.coalesce("has", F.lit(False)).alias("has_hits"))


@register("jn24_agents_with_counts", "SELECT c_custkey, c_name, coalesce(n, 0) AS calls FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def jn24_agents_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(n, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("calls"))


@register("srt04_usage_page", oracle("SELECT event_id, recorded_at FROM attempts WHERE recorded_at > TIMESTAMP '2024-01-05' OR (recorded_at = TIMESTAMP '2024-01-05' AND event_id > 0) ORDER BY recorded_at, event_id LIMIT 31"))
def srt04_usage_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyset_page(usage(spark, sf_dir), [("recorded_at", False), ("event_id", False)], [F.lit("2024-01-05").cast("timestamp_ntz"), F.lit(0)], 30).select("event_id", "recorded_at")


@register("srt06_claim_order", oracle("SELECT call_id, row_number() OVER (PARTITION BY agent_id ORDER BY CASE WHEN stream = '1-URGENT' THEN 0 ELSE 1 END, score_tenths DESC NULLS LAST, created_at, call_id) AS place FROM calls WHERE state = 'O'"))
def srt06_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("agent_id").orderBy(F.when(F.col("stream") == "1-URGENT", 0).otherwise(1), F.desc("score_tenths"), "created_at", "call_id")
    return calls(spark, sf_dir).where("state = 'O'").select("call_id", F.row_number().over(order).alias("place"))


@register("srt08_filtered_top_k", oracle("SELECT call_id, turn_id, hit_key, confidence_pct FROM hits WHERE speaker = 'CALLER' AND category_id <> 0 ORDER BY confidence_pct DESC, call_id, turn_id, hit_key LIMIT 25"))
def srt08_filtered_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is withheld goes before the best 25 are taken."""
    return hits(spark, sf_dir).where("speaker = 'CALLER' AND category_id <> 0").orderBy(F.desc("confidence_pct"), "call_id", "turn_id", "hit_key").limit(25).select("call_id", "turn_id", "hit_key", "confidence_pct")


@register("srt11_request_queue", oracle("SELECT call_id FROM calls WHERE requires_review ORDER BY stream, created_at, call_id LIMIT 40"))
def srt11_request_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).where("requires_review").orderBy("stream", "created_at", "call_id").limit(40).select("call_id")


@register("set07_changed_nodes", "SELECT coalesce(a.p_partkey, b.p_partkey) AS node, a.v IS NULL AS added, b.v IS NULL AS removed FROM (SELECT p_partkey, p_size % 7 AS v FROM part WHERE p_partkey % 5 > 0) a FULL JOIN (SELECT p_partkey, p_size % 5 AS v FROM part WHERE p_partkey % 4 > 0) b ON a.p_partkey = b.p_partkey WHERE a.v IS DISTINCT FROM b.v")
def set07_changed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of two versions of a tree that differ."""
    p = table(spark, sf_dir, "part")
    old = p.where("p_partkey % 5 > 0").select(F.col("p_partkey").alias("node"), F.expr("p_size % 7").alias("a"))
    new = p.where("p_partkey % 4 > 0").select(F.col("p_partkey").alias("node"), F.expr("p_size % 5").alias("b"))
    return old.join(new, "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("node", F.col("a").isNull().alias("added"), F.col("b").isNull().alias("removed"))
