"""Finding and masking personal data, consistently over all texts of a group."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnwise.functions.readouts import NONE, REDACTED, _spoken, labelled, mask_values, scanned, with_findings
from turnwise.registry import register
from turnwise.sources.tables import table

# Patterns of what is masked, in order of priority.
PATTERNS = (
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("PHONE", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
    ("CARD", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("IP", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
)


def find_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, label, value), earlier patterns first to claim a place."""
    taken: list[tuple[int, int, str, str]] = []
    for label, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            if all(m.end() <= a or m.start() >= b for a, b, _, _ in taken):
                taken.append((m.start(), m.end(), label, m.group()))
    return sorted(taken)


def spans(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, start, end, label, value) of every finding; texts without a digit or '@' are not looked at."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(i, *s) for i, t in zip(f["id"], f["text"], strict=True) for s in find_spans(t)]
            yield pd.DataFrame(found, columns=["id", "start", "end", "label", "value"])

    some = texts.where(F.col(text_col).rlike("[0-9@]")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return some.mapInPandas(run, "id bigint, start int, end int, label string, value string").withColumnRenamed("id", id_col)


@register(
    "str20_pii_counts",
    r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS emails, len(regexp_extract_all(text, '\+1 \(\d{3}\) \d{3}-\d{4}')) AS phones, len(regexp_extract_all(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')) AS ips FROM documents",
)
def str20_pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dict(PATTERNS)
    return table(spark, sf_dir, "documents").select("doc_id", *[F.regexp_count("text", F.lit(p[k])).cast("bigint").alias(n) for k, n in (("EMAIL", "emails"), ("PHONE", "phones"), ("IP", "ips"))])


@register(
    "str24_mask_patterns",
    r"SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', '[REDACTED]', 'g'), '\+1 \(\d{3}\) \d{3}-\d{4}', '[REDACTED]', 'g') AS masked FROM documents",
)
def str24_mask_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masking by pattern stays inside code generation."""
    p = dict(PATTERNS)
    masked = F.regexp_replace(F.regexp_replace("text", p["EMAIL"], "[REDACTED]"), p["PHONE"], "[REDACTED]")
    return table(spark, sf_dir, "documents").select("doc_id", masked.alias("masked"))


def masked_at(text: Column, spans: Column) -> Column:
    """Every span (start, end) replaced, last span first so that earlier places hold."""
    return F.aggregate(spans, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit("[REDACTED]"), F.substring(t, s["end"] + 1, F.length(t))))


def mask_by_position(texts: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """Every finding's span replaced."""
    per = found.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start", "end")), asc=False).alias("spans"))
    masked = masked_at(F.col("text"), F.col("spans"))
    return texts.join(per, id_col, "left").select(id_col, F.when(F.col("spans").isNull(), F.col("text")).otherwise(masked).alias("masked"))


@register("str25_mask_by_position")
def str25_mask_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the detector of read-out numbers finds in the documents, masked where it stands; text and findings stay in one row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("context"), F.col("text").isNull().alias("none"))
    own = labelled(F.col("found"), F.lit(NONE), F.col("text"))
    spans = F.sort_array(F.transform(own, lambda x: F.struct(x["begin"].alias("start"), x["end"].alias("end"))), asc=False)
    return with_findings(docs).select("doc_id", F.when(~F.col("none"), masked_at(F.col("text"), spans)).alias("masked"))


def consistent_mask(texts: DataFrame, found: DataFrame, keys: list[str], group: str) -> DataFrame:
    """(keys, masked): every value found anywhere in a group is masked in all its texts, longest first.

    texts: keys with the group among them, text, revision (of the group's texts); found: group,
    value, revision (that was searched; a null value for a group without findings). A group whose
    findings are for another revision, or that was not searched at all, is masked whole.
    """
    per = found.groupBy(group).agg(F.collect_set("value").alias("values"), F.min("revision").alias("oldest"), F.max("revision").alias("newest"))
    known = texts.join(per, group, "left")
    current = F.coalesce((F.col("oldest") == F.col("revision")) & (F.col("newest") == F.col("revision")), F.lit(False))
    return known.select(*keys, F.when(F.col("text").isNull(), None).when(current, mask_values(F.col("text"), F.col("values"))).otherwise(REDACTED).alias("masked"))


@register("str27_consistent_mask")
def str27_consistent_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls' read-outs masked in all their turns; of each tenth call another revision was searched."""
    spoken = _spoken(spark, sf_dir)
    revision = F.when(F.col("conv_id") % 10 == 3, 2).otherwise(1)
    found = scanned(spoken).select("conv_id", F.explode_outer("values").alias("value"), F.lit(1).alias("revision"))
    return consistent_mask(spoken.select("conv_id", "turn", "text", revision.alias("revision")), found, ["conv_id", "turn"], "conv_id")
