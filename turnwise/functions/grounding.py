"""Extracted fields held against the text that they come from, and numbers in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnwise.functions.readouts import NONE, REDACTED, SCALES, TEENS, TENS, UNITS, findings
from turnwise.registry import register
from turnwise.sources.tables import oracle, table, turns

#: Words of a spelled number and what they stand for; a scale multiplies what was said before it.
NUMBERS = {k: v for k, v in {**UNITS, **TEENS, **TENS}.items() if k not in ("oh", "ohh", "o")}
MULTIPLIES = {**SCALES, "million": 1_000_000}
SURFACE_TYPES = ("string", "number", "amount", "date")


def _value(word: Column, values: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), word)


def number_value(text: Column) -> Column:
    """The number in a text: its first numeral, else the first spelled one ("two hundred and six thousand"); null without any.

    A fold over the words: a number adds to what is being said, "hundred" multiplies that, larger
    scales close it; "and" and "a" go on, any other word after a number ends it.
    """
    numeral = F.regexp_extract(text, r"-?\d[\d,]*(?:\.\d+)?", 0)
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("said"), F.lit(False).alias("found"), F.lit(False).alias("over"))

    def step(a: Column, w: Column) -> Column:
        n, by = _value(w, NUMBERS), _value(w, MULTIPLIES)
        state = lambda total, said, found, over: F.struct(total.cast("bigint").alias("total"), said.cast("bigint").alias("said"), found.alias("found"), over.alias("over"))
        yes, no, most = F.lit(True), F.lit(False), F.greatest(a["said"], F.lit(1))
        return (
            F.when(a["over"], a)
            .when(n.isNotNull(), state(a["total"], a["said"] + n, yes, no))
            .when(a["found"] & (by == 100), state(a["total"], most * 100, yes, no))
            .when(a["found"] & by.isNotNull(), state(a["total"] + most * by, F.lit(0), yes, no))
            .when(a["found"] & ~w.isin("and", "a"), state(a["total"], a["said"], yes, yes))
            .otherwise(a)
        )

    spelled = F.aggregate(words, start, step, lambda a: F.when(a["found"], (a["total"] + a["said"]).cast("double")))
    return F.when(numeral != "", F.replace(numeral, F.lit(","), F.lit("")).cast("double")).otherwise(spelled)


def date_value(text: Column) -> Column:
    """The ISO date of a text that is one, as 2024-03-09, 3/9/2024 or March 9, 2024."""
    t = F.trim(text)
    return F.coalesce(*[x.cast("string") for x in (F.try_to_timestamp(t, F.lit("yyyy-M-d")).cast("date"), F.try_to_timestamp(t, F.lit("M/d/yyyy")).cast("date"), F.try_to_timestamp(F.initcap(t), F.lit("MMMM d, yyyy")).cast("date"))])


def ground_fields(answers: DataFrame, spans: DataFrame, key: str, field: str, detect: bool = True) -> DataFrame:
    """(key, field, type, status, value, surface, char_begin, char_end) of every answer, by the text of its span.

    answers: key, field, type, answer, evidence, requires_evidence, enum_values; spans: key, text,
    char_start, sensitive (values of the call that must not be shown). status, by the first rule:
    absent (no answer), invalid (no boolean or none of the enum's values), ungrounded (the answer,
    or the evidence that a boolean or enum requires, is not in the text letter by letter),
    withheld_pii (it holds a mask or a sensitive value, or what the detector finds, if `detect`),
    invalid (no number or date), extracted. Enums are matched in any case and given as
    declared. Places count from char_start; withheld and ungrounded answers show neither value nor place.
    """
    a = answers.join(spans.select(key, "text", "char_start", "sensitive"), key)
    by_surface = F.col("type").isin(*SURFACE_TYPES)
    checked = F.when(by_surface, F.col("answer")).when(F.col("requires_evidence"), F.col("evidence"))
    a = a.withColumn("surface", checked)
    if detect:
        rows = a.where(F.coalesce("surface", F.lit("")) != "").select(key, field, F.col("surface").alias("text"), F.lit("").alias("context")).distinct()
        found = findings(rows, [key, field]).where(F.exists("found", lambda x: x["labels"][NONE].isNotNull())).select(key, field, F.lit(True).alias("detected"))
        a = a.join(found, [key, field], "left")
    else:
        a = a.withColumn("detected", F.lit(None).cast("boolean"))
    needs = F.col("surface").isNotNull() | (~by_surface & F.col("requires_evidence"))
    at = F.when(F.coalesce("surface", F.lit("")) != "", F.call_function("instr", "text", "surface")).otherwise(0)
    hidden = F.contains("surface", F.lit(REDACTED)) | F.coalesce(F.exists("sensitive", lambda v: (v != "") & F.contains(F.col("surface"), v)), F.lit(False)) | F.coalesce("detected", F.lit(False))
    declared = F.get(F.filter("enum_values", lambda v: F.lower(v) == F.lower("answer")), F.lit(0))
    value = F.when(F.col("type") == "string", F.col("answer")).when(F.col("type").isin("number", "amount"), number_value(F.col("answer")).cast("string")).when(F.col("type") == "date", date_value(F.col("answer"))).when(F.col("type") == "boolean", F.when(F.lower("answer").isin("true", "false"), F.lower("answer"))).otherwise(declared)
    status = (
        F.when(F.trim(F.coalesce("answer", F.lit(""))) == "", "absent")
        .when(~by_surface & value.isNull(), "invalid")
        .when(needs & (at == 0), "ungrounded")
        .when(needs & hidden, "withheld_pii")
        .when(value.isNull(), "invalid")
        .otherwise("extracted")
    )
    a = a.withColumn("status", status).withColumn("at", F.when(needs, F.col("char_start") + at - 1)).withColumn("found_value", value)
    shown = F.col("status").isin("extracted", "invalid") & (F.col("at") >= F.col("char_start"))
    return a.select(key, field, "type", "status", F.when(F.col("status") == "extracted", F.col("found_value")).alias("value"), F.when(shown, F.col("surface")).alias("surface"), F.when(shown, F.col("at")).alias("char_begin"), F.when(shown, F.col("at") + F.length("surface")).alias("char_end"))


@register("fn03_spelled_number", "SELECT p_partkey, CAST(p_size * 1000 + p_partkey % 100 AS DOUBLE) AS value FROM part WHERE p_size BETWEEN 1 AND 99")
def fn03_spelled_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers put in words and read back: "forty-two thousand and seven dollars"."""
    small = F.array(*[F.lit(w) for w, _ in sorted({**{k: v for k, v in NUMBERS.items() if v < 20}}.items(), key=lambda x: x[1])])
    tens = F.array(F.lit(""), F.lit(""), *[F.lit(w) for w in TENS])
    said = lambda n: F.when(n < 20, F.get(small, n)).when(n % 10 == 0, F.get(tens, F.floor(n / 10).cast("int"))).otherwise(F.concat(F.get(tens, F.floor(n / 10).cast("int")), F.lit("-"), F.get(small, n % 10)))
    rest = (F.col("p_partkey") % 100).cast("int")
    text = F.concat(said(F.col("p_size").cast("int")), F.lit(" thousand"), F.when(rest > 0, F.concat(F.lit(" and "), said(rest))).otherwise(""), F.lit(" dollars"))
    return table(spark, sf_dir, "part").where("p_size BETWEEN 1 AND 99").select("p_partkey", number_value(text).alias("value"))


@register(
    "fn19_field_grounding",
    oracle("""
, a AS (SELECT conv_id, turn, text, (conv_id * 7 + turn) % 6 AS k, turn % 2 = 0 AS hides FROM turns),
s AS (SELECT *, CASE k WHEN 0 THEN substr(text, 3, 8) WHEN 1 THEN reverse(substr(text, 3, 8)) || '~' WHEN 2 THEN 'YES' WHEN 3 THEN 'maybe' WHEN 5 THEN 'true' END AS answer,
  CASE WHEN k < 2 THEN 'string' WHEN k = 5 THEN 'boolean' ELSE 'enum' END AS type, CASE k WHEN 0 THEN substr(text, 3, 8) WHEN 1 THEN reverse(substr(text, 3, 8)) || '~' WHEN 2 THEN substr(text, 2, 6) END AS surface FROM a),
t AS (SELECT *, CASE WHEN coalesce(trim(answer, ' '), '') = '' THEN 'absent' WHEN k = 3 THEN 'invalid' WHEN k < 3 AND (coalesce(surface, '') = '' OR instr(text, surface) = 0) THEN 'ungrounded'
  WHEN k < 3 AND hides AND length(text) >= 3 AND contains(surface, substr(text, 3, 4)) THEN 'withheld_pii' ELSE 'extracted' END AS status FROM s)
SELECT conv_id, turn, type, status, CASE WHEN status = 'extracted' THEN CASE WHEN k = 2 THEN 'yes' ELSE answer END END AS value, CASE WHEN status = 'extracted' AND k < 3 THEN CAST(instr(text, surface) + 9 AS BIGINT) END AS char_begin FROM t"""),
)
def fn19_field_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of every kind about each turn: letters that are there or not, enums, a boolean, none; four letters of every second turn are sensitive."""
    t = turns(spark, sf_dir).withColumn("k", (F.col("conv_id") * 7 + F.col("turn")) % 6).withColumn("id", F.struct("conv_id", "turn"))
    part = F.substring("text", 3, 8)
    answer = F.when(F.col("k") == 0, part).when(F.col("k") == 1, F.concat(F.reverse(part), F.lit("~"))).when(F.col("k") == 2, "YES").when(F.col("k") == 3, "maybe").when(F.col("k") == 5, "true")
    kind = F.when(F.col("k") < 2, "string").when(F.col("k") == 5, "boolean").otherwise("enum")
    answers = t.select("id", F.lit("f").alias("field"), kind.alias("type"), answer.alias("answer"), F.substring("text", 2, 6).alias("evidence"), (F.col("k") == 2).alias("requires_evidence"), F.array(F.lit("yes"), F.lit("no")).alias("enum_values"))
    spans = t.select("id", "text", F.lit(10).cast("bigint").alias("char_start"), F.when(F.col("turn") % 2 == 0, F.array(F.substring("text", 3, 4))).alias("sensitive"))
    return ground_fields(answers, spans, "id", "field", detect=False).select("id.conv_id", "id.turn", "type", "status", "value", "char_begin")
