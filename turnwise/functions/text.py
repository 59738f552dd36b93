"""Text operators: normal forms, evidence, phrases, citations, entities, fuzzy ratios, word errors.

Built-in expressions where they exist; Arrow-batched Python for alignment and Unicode forms.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnwise.registry import register
from turnwise.sources.tables import oracle, table, turns

PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def normal_quote(text: Column) -> Column:
    """Lower case, no ASCII punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, ""), r"[ \t\n\r]+", " "))


_NORMAL = r"""trim(regexp_replace(regexp_replace(lower({}), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ')"""


@register("str01_normal_quote", f"SELECT doc_id, {_NORMAL.format('text')} AS quote FROM documents")
def str01_normal_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", normal_quote(F.col("text")).alias("quote"))


@register("str02_normal_lexicon", r"SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '\([^)]*\)|~', '', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ')) AS lexical FROM documents")
def str02_normal_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without bracketed remarks and tildes."""
    bare = F.regexp_replace(F.regexp_replace("text", r"\([^)]*\)|~", ""), r"[ \t\n\r]+", " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.trim(bare)).alias("lexical"))


def fold_accents(text: Column) -> Column:
    """NFKD without marks: there is no built-in for it."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))

    return fold(text)


@register("str03_fold_accents", "SELECT doc_id, strip_accents(text) AS folded FROM documents")
def str03_fold_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fold_accents(F.col("text")).alias("folded"))


@register(
    "str04_lexicon_and_veto",
    oracle(r"SELECT conv_id, turn, regexp_matches(lower(text), '\b(the|of|and)\b') AS found, regexp_matches(lower(text), '\b(not|no|never|is)\b( [^ ]+){0,2} (the|of|and)\b') AS vetoed FROM turns"),
)
def str04_lexicon_and_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon match, and whether a cue lies three words or less before one."""
    low = F.lower("text")
    return turns(spark, sf_dir).select("conv_id", "turn", low.rlike(r"\b(the|of|and)\b").alias("found"), low.rlike(r"\b(not|no|never|is)\b( [^ ]+){0,2} (the|of|and)\b").alias("vetoed"))


def evidence(texts: DataFrame, quotes: DataFrame, id_col: str, quote_id: str) -> DataFrame:
    """(quote, text) pairs whose normalised text contains the normalised quote; an empty quote is in none.

    A quote may begin and end inside words of the text, but the words between are whole there.
    Quotes meet texts on the first of those, three at most, found among each text's runs of as
    many words: an equi-join of ids and keys. Only the pairs that meet fetch their text, for the
    substring test. Quotes of one or two words have no such word; they are tested against the
    distinct words and pairs of neighbours of all texts, each of which stands for its texts.
    """
    t = texts.select(F.col(id_col), normal_quote(F.col("text")).alias("norm"))
    parts = F.split("quote", " ")
    q = quotes.select(F.col(quote_id), normal_quote(F.col("text")).alias("quote")).where("quote <> ''").withColumn("inner", F.least(F.greatest(F.size(parts) - 2, F.lit(0)), F.lit(3)))
    q = q.withColumn("key", F.array_join(F.slice(parts, F.lit(2), F.col("inner")), " "))
    runs = lambda n: F.array_distinct(F.expr(f"transform(sequence(1, greatest(size(words) - {n - 1}, 1)), i -> array_join(slice(words, i, {n}), ' '))"))
    met = None
    # Four lengths at most; texts are cut into runs of those that occur.
    for n in sorted(r[0] for r in q.select("inner").distinct().collect()) or [0]:
        some = q.where(F.col("inner") == n).select(quote_id, "quote", "key")
        cut = t.withColumn("words", F.split("norm", " ")).select(id_col, F.explode(runs(n or 2)).alias("key"))
        if not n:
            # The pairs of short quotes and runs that hold them: as many runs as the texts' language has.
            some = cut.select("key").distinct().join(some.drop("key"), F.contains("key", "quote")).select("key", quote_id)
        pairs = cut.join(some.select("key", quote_id), "key").select(quote_id, id_col)
        met = pairs if met is None else met.unionByName(pairs)
    return met.distinct().join(q.select(quote_id, "quote"), quote_id).join(t, id_col).where(F.contains("norm", "quote")).select(quote_id, id_col).distinct()


@register(
    "str05_verbatim_evidence",
    f"WITH d AS (SELECT doc_id, {_NORMAL.format('text')} AS norm FROM documents), b AS (SELECT item_id, {_NORMAL.format('text')} AS quote FROM benchmark) SELECT DISTINCT item_id, doc_id FROM d JOIN b ON quote <> '' AND contains(norm, quote)",
)
def str05_verbatim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


def sequence_ratio(a: str, b: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b, autojunk=False).ratio() * 100


def fuzzy_ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([sequence_ratio(i, j) for i, j in zip(x, y, strict=True)])

    return ratio(a, b)


@register("str06_fuzzy_ratio")
def str06_fuzzy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching-blocks ratio of part names with their brand's first name; no built-in has it."""
    p = table(spark, sf_dir, "part")
    first = p.groupBy("p_brand").agg(F.min("p_name").alias("first"))
    return p.join(first, "p_brand").select("p_partkey", fuzzy_ratio(F.col("p_name"), F.col("first")).alias("ratio"))


@register("str09_custom_regex", oracle(r"SELECT conv_id, min(turn) AS turn FROM turns WHERE regexp_matches(text, '(?i)\bth[a-z]+ing\b') GROUP BY 1"))
def str09_custom_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn that a pattern matches, in either case."""
    return turns(spark, sf_dir).where(F.col("text").rlike(r"(?i)\bth[a-z]+ing\b")).groupBy("conv_id").agg(F.min("turn").alias("turn"))


@register("str10_levenshtein", "SELECT p_partkey, 1 - CAST(levenshtein(p_name, p_type) AS DOUBLE) / greatest(length(p_name), length(p_type)) AS similarity FROM part")
def str10_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    sim = 1 - F.levenshtein("p_name", "p_type").cast("double") / F.greatest(F.length("p_name"), F.length("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", sim.alias("similarity"))


#: Typed numbers in order of priority: an earlier type's span is not offered to a later one.
NUMBERS = (("phone", r"\+1 \(\d{3}\) \d{3}-\d{4}"), ("long", r"\b\d{13,19}\b"), ("percent", r"\b\d+(?:\.\d+)?%"), ("plain", r"\b\d+(?:\.\d+)?\b"))


@register(
    "str16_numbers_by_type",
    r"SELECT doc_id, len(regexp_extract_all(text, '\+1 \(\d{3}\) \d{3}-\d{4}')) AS phones, len(regexp_extract_all(text, '\b\d{13,19}\b')) AS long_numbers, len(regexp_extract_all(text, '\b\d+(?:\.\d+)?%')) AS percents FROM documents",
)
def str16_numbers_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"phone": "phones", "long": "long_numbers", "percent": "percents"}
    return table(spark, sf_dir, "documents").select("doc_id", *[F.regexp_count("text", F.lit(p)).cast("bigint").alias(names[n]) for n, p in NUMBERS if n in names])


@register("str17_number_value", "SELECT p_partkey, TRY_CAST(nullif(regexp_replace(p_brand, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS value FROM part")
def str17_number_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_brand", "[^0-9.]", "").try_cast("double").alias("value"))


@register("str29_token_estimate", oracle("SELECT conv_id, turn, greatest(words * 13 // 10 + 1, (octet_length(encode(text)) + 2) // 3) AS tokens FROM turns"))
def str29_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", F.expr("greatest(words * 13 div 10 + 1, (octet_length(text) + 2) div 3)").alias("tokens"))


@register("str30_cut_on_word", r"SELECT doc_id, CASE WHEN length(text) > 80 THEN regexp_replace(regexp_replace(substr(text, 1, 80), ' [^ ]*$', ''), '[ ,;:]+$', '') ELSE text END AS head FROM documents")
def str30_cut_on_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title of 80 characters at most, cut at a space."""
    head = F.regexp_replace(F.regexp_replace(F.substring("text", 1, 80), r" [^ ]*\z", ""), r"[ ,;:]+\z", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.length("text") > 80, head).otherwise(F.col("text")).alias("head"))


@register("str31_whole_phrase", r"SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9_])of the([^a-z0-9_]|$)') AS mentions FROM documents")
def str31_whole_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lower("text").rlike("(^|[^a-z0-9_])of the([^a-z0-9_]|$)").alias("mentions"))


@register("str32_citations", oracle(r"SELECT conv_id, turn, array_to_string(regexp_extract_all(text || ' (turns ' || turn || ', ' || (turn + 1) || ')', '\(turns? ([0-9, ]+)\)', 1), ';') AS cited FROM turns"))
def str32_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn numbers that a text cites in brackets."""
    cited = F.concat("text", F.lit(" (turns "), F.col("turn").cast("string"), F.lit(", "), (F.col("turn") + 1).cast("string"), F.lit(")"))
    return turns(spark, sf_dir).select("conv_id", "turn", F.array_join(F.regexp_extract_all(cited, F.lit(r"\(turns? ([0-9, ]+)\)"), 1), ";").alias("cited"))


@register(
    "str33_grounding",
    oracle("SELECT a.conv_id, a.turn, len(list_intersect(regexp_extract_all(lower(a.text), '[a-z]{3,}'), regexp_extract_all(lower(b.text), '[a-z]{3,}'))) >= 2 AS grounded FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1"),
)
def str33_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn shares two words of three letters with the one before."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)
    t = turns(spark, sf_dir).select("conv_id", "turn", tokens.alias("own"))
    before = F.lag("own").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.withColumn("before", before).where("before IS NOT NULL").select("conv_id", "turn", (F.size(F.array_intersect("own", "before")) >= 2).alias("grounded"))


@register("str36_turn_kind", oracle("SELECT conv_id, turn, CASE WHEN words <= 2 THEN 'ack' WHEN words <= 5 THEN 'filler' ELSE 'content' END AS kind FROM turns"))
def str36_turn_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", F.when(F.col("words") <= 2, "ack").when(F.col("words") <= 5, "filler").otherwise("content").alias("kind"))


@register(
    "str37_polarity",
    oracle("SELECT conv_id, turn, greatest(-100, least(100, 15 * len(list_filter(t, lambda w: starts_with(w, 'th'))) - 20 * len(list_filter(t, lambda w: starts_with(w, 're'))))) AS polarity_pct FROM (SELECT *, string_split(lower(text), ' ') AS t FROM turns)"),
)
def str37_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon's stand-in for a sentiment model: prefixes count up or down, clamped."""
    t = F.split(F.lower("text"), " ")
    n = lambda p: F.size(F.filter(t, lambda w: w.startswith(p))).cast("bigint")
    return turns(spark, sf_dir).select("conv_id", "turn", F.greatest(F.lit(-100), F.least(F.lit(100), n("th") * 15 - n("re") * 20)).alias("polarity_pct"))


def word_errors(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int]:
    """Substitutions, deletions, insertions of the cheapest alignment; ties in this order."""
    row = [(j, 0, 0, j) for j in range(len(hypothesis) + 1)]
    for i, r in enumerate(reference, 1):
        last, row = row, [(i, 0, i, 0)]
        for j, h in enumerate(hypothesis, 1):
            c, s, d, n = last[j - 1]
            best = (c, s, d, n) if r == h else (c + 1, s + 1, d, n)
            for cand in ((last[j][0] + 1, last[j][1], last[j][2] + 1, last[j][3]), (row[j - 1][0] + 1, row[j - 1][1], row[j - 1][2], row[j - 1][3] + 1)):
                if cand[0] < best[0]:
                    best = cand
            row.append(best)
    return row[-1][1:]


@register("ag31_word_error_rate")
def ag31_word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-averaged per conversation: each turn against the one before as if it were its transcript, by the words of `word_list`."""
    from turnwise.operators.evaluation import word_list

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turns(spark, sf_dir).select("conv_id", F.col("text").alias("h"), before.alias("r")).where("r IS NOT NULL").select("conv_id", word_list(F.col("h")).alias("h"), word_list(F.col("r")).alias("r"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            e = [(*word_errors(list(r), list(h)), len(r)) for r, h in zip(f["r"], f["h"], strict=True)]
            yield pd.DataFrame({"conv_id": f["conv_id"], **{k: [x[i] for x in e] for i, k in enumerate(("s", "d", "i", "n"))}})

    sums = pairs.mapInPandas(run, "conv_id bigint, s bigint, d bigint, i bigint, n bigint").groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("s", "d", "i", "n")])
    return sums.withColumn("wer", F.try_divide(F.col("s") + F.col("d") + F.col("i"), F.col("n")))


@register("str40_agent_label", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_name || ' (' || c_nationkey || ')' ELSE c_name END AS label FROM customer")
def str40_agent_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name with its extension in brackets, where there is one."""
    ext = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit(" ("), F.col("c_nationkey").cast("string"), F.lit(")")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.coalesce(ext, F.lit(""))).alias("label"))


@register("str41_clock", oracle("SELECT conv_id, turn, format('{}:{:02d}', start_ds // 600, start_ds // 10 % 60) AS clock FROM turns"))
def str41_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", F.format_string("%d:%02d", F.expr("start_ds div 600"), F.expr("start_ds div 10 % 60")).alias("clock"))
