"""Sources and sinks: natural keys, merges, content digests, probes, JSON lines and CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnwise.registry import register
from turnwise.session import materialise, shared_dir
from turnwise.sources.tables import calls, oracle, overrides, table, usage


@register("src01_scan", "SELECT conv_id, turn, role, text FROM conversations")
def src01_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@register("src04_content_digests", "SELECT 'sha256:' || sha256(html) AS digest, min(page_id) AS page_id, count(*) AS copies FROM pages GROUP BY 1")
def src04_content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed objects: one for each digest."""
    digest = F.concat(F.lit("sha256:"), F.sha2("html", 256))
    return table(spark, sf_dir, "pages").groupBy(digest.alias("digest")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


def register_new(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Existing rows and those incoming ones whose natural key is new; repeats of a key come in once."""
    return existing.unionByName(incoming.dropDuplicates(list(key)).join(existing, list(key), "left_anti"))


@register("src06_natural_key", "SELECT user_id, event_type FROM events WHERE event_id % 2 = 0 GROUP BY ALL UNION SELECT user_id, event_type FROM events WHERE event_id % 2 = 1 GROUP BY ALL")
def src06_natural_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    half = lambda k: e.where(F.col("event_id") % 2 == k).select("user_id", "event_type").distinct()
    return register_new(half(0), half(1), ["user_id", "event_type"])


def merge_fields(stored: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Only fields that are set replace stored ones; `changed` lists them."""
    new = incoming.select(key, *[F.col(f).alias(f"new_{f}") for f in fields])
    both = stored.join(new, key, "full")
    changed = F.array_compact(F.array(*[F.when(F.col(f"new_{f}").isNotNull() & ~F.col(f"new_{f}").eqNullSafe(F.col(f)), F.lit(f)) for f in fields]))
    return both.select(key, *[F.coalesce(f"new_{f}", f).alias(f) for f in fields], F.array_join(changed, ",").alias("changed"))


@register(
    "src07_merge_fields",
    oracle("SELECT call_id, CASE WHEN call_id % 4 = 0 THEN 'X' ELSE state END AS state, CASE WHEN call_id % 6 = 0 THEN 'moved' ELSE stream END AS stream, array_to_string(list_filter([CASE WHEN call_id % 4 = 0 THEN 'state' END, CASE WHEN call_id % 6 = 0 THEN 'stream' END], lambda x: x IS NOT NULL), ',') AS changed FROM calls"),
)
def src07_merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir).select("call_id", "state", "stream")
    incoming = c.where("call_id % 2 = 0 OR call_id % 3 = 0").select("call_id", F.when(F.col("call_id") % 4 == 0, "X").alias("state"), F.when(F.col("call_id") % 6 == 0, "moved").alias("stream"))
    return merge_fields(c, incoming, "call_id", ["state", "stream"])


@register("src08_log_fold", oracle("SELECT job_id, max_by(outcome, event_id) AS outcome, count(*) AS entries, count(DISTINCT route_class) AS kinds FROM attempts GROUP BY 1"))
def src08_log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log folded to its newest state by key."""
    return usage(spark, sf_dir).groupBy("job_id").agg(F.max_by("outcome", "event_id").alias("outcome"), F.count("*").alias("entries"), F.countDistinct("route_class").alias("kinds"))


@register("src09_json_lines", oracle("SELECT call_id, state, stream FROM calls"))
def src09_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON lines by split and read again with the schema given."""
    import uuid

    path = f"{shared_dir(spark)}/turnwise/json-{uuid.uuid4().hex}"
    calls(spark, sf_dir).select("call_id", "state", "stream", F.expr("call_id % 3").alias("split")).write.partitionBy("split").json(path)
    return spark.read.schema("call_id BIGINT, state STRING, stream STRING, split BIGINT").json(path).drop("split")


@register("src10_csv", oracle("SELECT event_id, route_class, model, outcome, tokens_input FROM attempts"))
def src10_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV with a header, empty cells for NULL, and read again."""
    import uuid

    path = f"{shared_dir(spark)}/turnwise/csv-{uuid.uuid4().hex}"
    usage(spark, sf_dir).select("event_id", "route_class", "model", "outcome", "tokens_input").write.csv(path, header=True, nullValue="")
    return spark.read.csv(path, header=True, nullValue="", schema="event_id BIGINT, route_class STRING, model STRING, outcome STRING, tokens_input BIGINT")


@register("src12_probe", "SELECT page_id, CASE WHEN starts_with(lower(ltrim(html)), '<!doctype') THEN 'html5' WHEN starts_with(lower(ltrim(html)), '<html') THEN 'html' ELSE 'other' END AS kind FROM pages")
def src12_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What content is, from its first bytes."""
    head = F.lower(F.ltrim(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", F.when(head.startswith("<!doctype"), "html5").when(head.startswith("<html"), "html").otherwise("other").alias("kind"))


@register("src13_gates", "SELECT doc_id, CASE WHEN text IS NULL THEN 'MISSING' WHEN length(text) = 0 THEN 'EMPTY' WHEN length(text) < 50 THEN 'TOO_SHORT' WHEN length(text) > 20000 THEN 'TOO_LONG' WHEN lang NOT IN ('en', 'de') THEN 'UNSUPPORTED' ELSE 'OK' END AS status FROM documents")
def src13_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first gate that fails names the status."""
    n = F.length("text")
    status = F.when(n.isNull(), "MISSING").when(n == 0, "EMPTY").when(n < 50, "TOO_SHORT").when(n > 20000, "TOO_LONG").when(~F.col("lang").isin("en", "de"), "UNSUPPORTED").otherwise("OK")
    return table(spark, sf_dir, "documents").select("doc_id", status.alias("status"))


@register("src15_synthetic_history", "SELECT range AS call_id, range % 56 AS day, (range * 7919 % 1000) < 400 - range % 56 * 5 AS missed FROM range(560)")
def src15_synthetic_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """560 calls over 56 days whose miss rate declines."""
    return spark.range(560).select(F.col("id").alias("call_id"), (F.col("id") % 56).alias("day"), (F.col("id") * 7919 % 1000 < 400 - F.col("id") % 56 * 5).alias("missed"))


@register("src19_orphans", oracle("SELECT o.call_id, o.criterion_id FROM overrides o LEFT JOIN hits h ON o.call_id = h.call_id WHERE h.call_id IS NULL"))
def src19_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.sources.tables import hits

    return overrides(spark, sf_dir).join(hits(spark, sf_dir), "call_id", "left_anti").select("call_id", "criterion_id")
