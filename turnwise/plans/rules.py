"""Rule specifications compiled to predicates: alert rules and boolean trees.

A specification is read on the driver, once; what runs is one Catalyst expression.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnwise.operators.metrics import current_hits
from turnwise.registry import register
from turnwise.sources.tables import calls, hits, oracle


@dataclass(frozen=True)
class AlertRule:
    rule_id: str
    enabled: bool = True
    category_id: int | None = None
    subcategory_id: int | None = None
    speaker: str | None = None
    min_confidence_pct: int | None = None


def predicate(rule: AlertRule) -> Column:
    """Of a hit; FALSE for a disabled rule, which lets the optimizer drop its branch."""
    if not rule.enabled:
        return F.lit(False)
    parts = [F.col(n) == v for n in ("category_id", "subcategory_id", "speaker") if (v := getattr(rule, n)) is not None]
    if rule.min_confidence_pct is not None:
        parts.append(F.col("confidence_pct") >= rule.min_confidence_pct)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def tree(spec: Mapping[str, Any] | str, outcomes: Mapping[str, Column]) -> Column:
    """{"all": [...]}, {"any": [...]}, {"not": ...} or the name of an outcome."""
    if isinstance(spec, str):
        return outcomes[spec]
    if "not" in spec:
        return ~tree(spec["not"], outcomes)
    join, start = (lambda a, b: a & b, F.lit(True)) if "all" in spec else (lambda a, b: a | b, F.lit(False))
    return reduce(join, [tree(s, outcomes) for s in spec["all" if "all" in spec else "any"]], start)


RULES = (AlertRule("sure", category_id=2, min_confidence_pct=60), AlertRule("agent", speaker="AGENT", subcategory_id=4), AlertRule("off", enabled=False), AlertRule("any"))


def matches(hits: DataFrame, rules: Sequence[AlertRule]) -> DataFrame:
    """(rule_id, call_id, day): one pass over the hits, whatever the number of rules."""
    fired = F.array_compact(F.array(*[F.when(predicate(r), F.lit(r.rule_id)) for r in rules]))
    return hits.select("call_id", F.to_date("created_at").alias("day"), F.explode(fired).alias("rule_id")).distinct()


_FIRED = """, cur AS (SELECT h.*, c.created_at FROM hits h JOIN calls c USING (call_id, version)), fired AS (
SELECT 'sure' AS rule_id, call_id, CAST(created_at AS DATE) AS day FROM cur WHERE category_id = 2 AND confidence_pct >= 60
UNION SELECT 'agent', call_id, CAST(created_at AS DATE) FROM cur WHERE speaker = 'AGENT' AND subcategory_id = 4 UNION SELECT 'any', call_id, CAST(created_at AS DATE) FROM cur)"""


@register("flt09_alert_matches", oracle(_FIRED + "SELECT rule_id, call_id, day FROM fired"))
def flt09_alert_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(current_hits(hits(spark, sf_dir), calls(spark, sf_dir)), RULES)


@register("ag14_alert_rate", oracle(_FIRED + "SELECT rule_id, count(DISTINCT call_id) AS calls, count(DISTINCT day) AS days FROM fired GROUP BY 1"))
def ag14_alert_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(current_hits(hits(spark, sf_dir), calls(spark, sf_dir)), RULES).groupBy("rule_id").agg(F.countDistinct("call_id").alias("calls"), F.countDistinct("day").alias("days"))


SPEC = {"all": ["scored_low", {"any": ["critical", {"not": "review"}]}]}


@register("flt11_rule_tree", oracle("SELECT call_id, score_tenths < 600 AND (critical OR NOT requires_review) AS fires FROM calls"))
def flt11_rule_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = {"scored_low": F.col("score_tenths") < 600, "critical": F.col("critical"), "review": F.col("requires_review")}
    return calls(spark, sf_dir).select("call_id", tree(SPEC, outcomes).alias("fires"))


@register("flt10_disabled_rule", oracle("SELECT call_id FROM hits WHERE false"))
def flt10_disabled_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).where(predicate(RULES[2])).select("call_id")
