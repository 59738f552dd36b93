"""Job graphs: closure, blocked and ready jobs, states of groups, pairwise reduction.

Jobs are orders; a job requires the job of the same agent before it. Closures run as rounds
of joins, each cut by a written table, until no pair is new; every round follows twice as
long paths, so their number is logarithmic in the longest chain. What lies behind given jobs is
found by waves from these, without a closure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnwise.registry import register
from turnwise.session import materialise
from turnwise.sources.tables import calls, oracle


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job, upstream): chains cut every fifth job."""
    w = Window.partitionBy("agent_id").orderBy("created_at", "call_id")
    c = calls(spark, sf_dir).select("agent_id", F.col("call_id").alias("job"), F.lag("call_id").over(w).alias("upstream"), F.row_number().over(w).alias("nth"))
    return c.where("upstream IS NOT NULL AND nth % 5 <> 1").select("job", "upstream")


_EDGES = """
, o AS (SELECT call_id AS job, lag(call_id) OVER w AS upstream, row_number() OVER w AS nth, state FROM calls WINDOW w AS (PARTITION BY agent_id ORDER BY created_at, call_id)),
edges AS (SELECT job, upstream FROM o WHERE upstream IS NOT NULL AND nth % 5 <> 1)"""


def closure(edges: DataFrame) -> DataFrame:
    """(job, upstream, depth) of all paths: the shortest depth of each pair."""
    paths = materialise(edges.select("job", "upstream", F.lit(1).alias("depth")), "closure")
    n = paths.count()
    while True:
        further = paths.alias("a").join(paths.alias("b"), F.col("a.upstream") == F.col("b.job")).select("a.job", "b.upstream", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        paths = materialise(paths.unionByName(further).groupBy("job", "upstream").agg(F.min("depth").alias("depth")), "closure")
        if (now := paths.count()) == n:
            return paths
        n = now


def nearest_seed(edges: DataFrame, seeds: DataFrame, order: list[str]) -> DataFrame:
    """(job, seed, depth) of every job behind a seed: the one at the fewest edges, of those the first in the order.

    Waves go down the edges from all seeds at once and stop at jobs that were reached before, so each
    edge is followed once, whatever the number of paths; a cycle ends by itself. seeds: job and
    the columns of `order`, by which two seeds are told apart.
    """
    front = materialise(seeds.select(F.col("job").alias("at"), F.struct(*order, F.col("job").alias("seed")).alias("by")), "wave")
    reached, depth = None, 0
    while True:
        depth += 1
        wave = edges.join(front, edges["upstream"] == front["at"]).groupBy("job").agg(F.min("by").alias("by"))
        if reached is not None:
            wave = wave.join(reached, "job", "left_anti")
        wave = materialise(wave.withColumn("depth", F.lit(depth)), "wave")
        if wave.isEmpty():
            return (reached if reached is not None else wave).select("job", F.col("by.seed").alias("seed"), "depth")
        reached = wave if reached is None else reached.unionByName(wave)
        front = wave.select(F.col("job").alias("at"), "by")


_CLOSURE = _EDGES + ", c AS (WITH RECURSIVE r(job, upstream, depth) AS (SELECT job, upstream, 1 FROM edges UNION ALL SELECT r.job, e.upstream, depth + 1 FROM r JOIN edges e ON r.upstream = e.job) SELECT job, upstream, min(depth) AS depth FROM r GROUP BY 1, 2)"


@register("gr01_closure", oracle(_CLOSURE + "SELECT * FROM c"))
def gr01_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure(edges(spark, sf_dir))


@register("gr02_would_cycle", oracle(_CLOSURE + "SELECT job, upstream, EXISTS (SELECT 1 FROM c WHERE c.job = e.job AND c.upstream = e.upstream AND depth > 1) AS would_cycle FROM c e"))
def gr02_would_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an edge back from the upstream job would close a longer cycle than the pair."""
    return closure(edges(spark, sf_dir)).select("job", "upstream", (F.col("depth") > 1).alias("would_cycle"))


@register(
    "gr03_dead_blocked",
    oracle(_CLOSURE + "SELECT job, bool_or(u.state = 'F') AS dead_blocked FROM c JOIN calls u ON c.upstream = u.call_id GROUP BY 1"),
)
def gr03_dead_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs behind a failed one."""
    e = edges(spark, sf_dir)
    failed = calls(spark, sf_dir).where("state = 'F'").select(F.col("call_id").alias("job"))
    behind = nearest_seed(e, failed, []).select("job", F.lit(True).alias("dead"))
    return e.select("job").distinct().join(behind, "job", "left").select("job", F.coalesce("dead", F.lit(False)).alias("dead_blocked"))


@register("gr04_ready", oracle(_EDGES + "SELECT c.call_id AS job, coalesce(bool_and(u.state = 'P'), true) AS ready FROM calls c LEFT JOIN edges e ON c.call_id = e.job LEFT JOIN calls u ON e.upstream = u.call_id GROUP BY 1"))
def gr04_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job is ready when all its edges are satisfied; without edges at once."""
    c = calls(spark, sf_dir)
    states = c.select(F.col("call_id").alias("upstream"), "state")
    known = edges(spark, sf_dir).join(states, "upstream")
    return c.select(F.col("call_id").alias("job")).join(known, "job", "left").groupBy("job").agg(F.coalesce(F.every(F.col("state") == "P"), F.lit(True)).alias("ready"))


@register("gr05_first_failure", oracle(_CLOSURE + "SELECT job, min_by(upstream, (depth, upstream)) AS failed FROM c JOIN calls u ON c.upstream = u.call_id WHERE u.state = 'F' GROUP BY 1"))
def gr05_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest failed job upstream."""
    failed = calls(spark, sf_dir).where("state = 'F'").select(F.col("call_id").alias("job"))
    return nearest_seed(edges(spark, sf_dir), failed, []).select("job", F.col("seed").alias("failed"))


@register(
    "gr06_group_state",
    oracle("SELECT agent_id, CASE WHEN count_if(state = 'O') = count(*) THEN 'pending' WHEN count_if(state = 'F') = count(*) THEN 'failed' WHEN max_by(state, (created_at, call_id)) = 'F' THEN 'stale' WHEN count_if(state = 'P') > 0 THEN 'partial' ELSE 'available' END AS group_state FROM calls GROUP BY 1"),
)
def gr06_group_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s)
    newest = F.max_by("state", F.struct("created_at", "call_id"))
    state = F.when(n("O") == F.count("*"), "pending").when(n("F") == F.count("*"), "failed").when(newest == "F", "stale").when(n("P") > 0, "partial").otherwise("available")
    return calls(spark, sf_dir).groupBy("agent_id").agg(state.alias("group_state"))


@register(
    "gr07_reduce_levels",
    oracle("""
, n AS (SELECT agent_id, row_number() OVER (PARTITION BY agent_id ORDER BY created_at, call_id) - 1 AS leaf, count(*) OVER (PARTITION BY agent_id) AS all_leaves FROM calls),
k AS (SELECT agent_id, leaf, unnest(range(1, greatest(1, CAST(ceil(log2(all_leaves)) AS BIGINT)) + 1)) AS level FROM n)
SELECT agent_id, level, leaf // CAST(power(2, level) AS BIGINT) AS node, count(*) AS leaves FROM k GROUP BY ALL"""),
)
def gr07_reduce_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all levels of a pairwise reduction over an agent's calls, up to the root."""
    by = Window.partitionBy("agent_id")
    ranked = calls(spark, sf_dir).select("agent_id", (F.row_number().over(by.orderBy("created_at", "call_id")) - 1).alias("leaf"), F.count("*").over(by).alias("all_leaves"))
    top = F.greatest(F.lit(1), F.ceil(F.log2("all_leaves")).cast("bigint"))
    leaves = ranked.select("agent_id", "leaf", F.explode(F.sequence(F.lit(1).cast("bigint"), top)).alias("level"))
    return leaves.groupBy("agent_id", "level", F.expr("leaf div CAST(power(2, level) AS BIGINT)").alias("node")).agg(F.count("*").alias("leaves"))


#: Stages of a result and those that each one reads, in topological order.
STAGES = {"categorize": (), "thresholds": (), "spans": ("categorize", "thresholds"), "subcategorize": ("spans",), "extract": ("subcategorize",), "merge": ("spans", "subcategorize", "extract")}
#: Stages that a model runs; the others are worked out anew from what is stored.
MODELS = ("categorize", "subcategorize", "extract")


def plan_rerun(digests: DataFrame, item: str, stages: dict[str, tuple[str, ...]], models: tuple[str, ...], rerun_all: Column | None = None) -> DataFrame:
    """(item, run, rederive, carry, reasons) by the digests of (item, stage, old, new).

    A stage is stale if its digest differs from the one its result was made with, if it has none, or
    if a stage that it reads is stale; staleness is pushed down in the order of `stages`, one
    expression a stage, so there is one aggregation over the digests and no join. run: stale
    stages with a model, rederive: those without; carry: all others. reasons: for stages
    whose own digest differs "new" or "changed". rerun_all: a condition over an item's rows.
    A stage without a row is as stale as what it reads.
    """
    reason = F.when(F.col("new").isNull(), None).when(F.col("old").isNull(), "new").when(F.col("old") != F.col("new"), "changed")
    wide = digests.groupBy(item).agg(*[F.max(F.when(F.col("stage") == s, reason)).alias(f"_{s}") for s in stages], F.coalesce(F.bool_or(rerun_all), F.lit(False)).alias("_all") if rerun_all is not None else F.first(F.lit(False)).alias("_all"))
    stale: dict[str, Column] = {}
    for s, reads in stages.items():
        stale[s] = F.col("_all") | F.col(f"_{s}").isNotNull()
        for r in reads:
            stale[s] = stale[s] | stale[r]
    pick = lambda names, wanted: F.array_compact(F.array(*[F.when(stale[s] if wanted else ~stale[s], F.lit(s)) for s in names]))
    reasons = F.array_compact(F.array(*[F.when(F.col(f"_{s}").isNotNull(), F.concat(F.lit(f"{s}:"), F.col(f"_{s}"))) for s in stages]))
    return wide.select(item, pick([s for s in stages if s in models], True).alias("run"), pick([s for s in stages if s not in models], True).alias("rederive"), pick(list(stages), False).alias("carry"), reasons.alias("reasons"))


@register(
    "gr08_rerun_plan",
    oracle("""
, d AS (SELECT call_id, stage, CASE WHEN call_id % 17 = 0 THEN NULL ELSE md5(stage || (score_tenths % 5)) END AS old,
  md5(stage || CASE WHEN (score_tenths + length(stage)) % 9 = 0 THEN 9 ELSE score_tenths % 5 END) AS new, state FROM calls, (SELECT unnest(['categorize', 'thresholds', 'subcategorize', 'extract']) AS stage)),
w AS (SELECT call_id, bool_or(state = 'P') AS al, bool_or(stage = 'categorize' AND old IS DISTINCT FROM new) AS c, bool_or(stage = 'thresholds' AND old IS DISTINCT FROM new) AS t,
  bool_or(stage = 'subcategorize' AND old IS DISTINCT FROM new) AS s, bool_or(stage = 'extract' AND old IS DISTINCT FROM new) AS x FROM d GROUP BY 1),
z AS (SELECT call_id, al OR c AS c, al OR t AS t, al OR c OR t AS p, al OR c OR t OR s AS s, al OR c OR t OR s OR x AS x FROM w)
SELECT call_id, concat_ws(',', CASE WHEN c THEN 'categorize' END, CASE WHEN s THEN 'subcategorize' END, CASE WHEN x THEN 'extract' END) AS run,
  concat_ws(',', CASE WHEN t THEN 'thresholds' END, CASE WHEN p THEN 'spans' END, CASE WHEN x THEN 'merge' END) AS rederive,
  concat_ws(',', CASE WHEN NOT c THEN 'categorize' END, CASE WHEN NOT t THEN 'thresholds' END, CASE WHEN NOT p THEN 'spans' END, CASE WHEN NOT s THEN 'subcategorize' END, CASE WHEN NOT x THEN 'extract' END, CASE WHEN NOT x THEN 'merge' END) AS carry
FROM z"""),
)
def gr08_rerun_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each call's result has to run again after its taxonomy changed; calls in state P run all."""
    c = calls(spark, sf_dir).select("call_id", "state", "score_tenths", F.explode(F.array(*[F.lit(s) for s in ("categorize", "thresholds", "subcategorize", "extract")])).alias("stage"))
    made = lambda v: F.md5(F.concat("stage", v.cast("string")))
    fifth = F.col("score_tenths") % 5
    d = c.select("call_id", "state", "stage", F.when(F.col("call_id") % 17 != 0, made(fifth)).alias("old"), made(F.when((F.col("score_tenths") + F.length("stage")) % 9 == 0, 9).otherwise(fifth)).alias("new"))
    plan = plan_rerun(d, "call_id", STAGES, MODELS, F.col("state") == "P")
    return plan.select("call_id", *[F.array_join(n, ",").alias(n) for n in ("run", "rederive", "carry")])
