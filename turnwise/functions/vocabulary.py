"""Vocabulary terms in transcripts: their normal forms, places of words, hits, and replacements.

Terms match on joined letters, so that spacing and hyphens do not matter: "silver brook" holds
"Silverbrook". Every run of consecutive tokens gives a rolling key, their letters joined; keys meet
the vocabulary in an equi-join, and of overlapping hits the earlier start and then the longer
term wins. A unit (a document, a conversation's channel) consists of turns; a turn borrows the
first tokens of the next ones, so a hit may cross turns while no more than those tokens are
shuffled. All of it is built-in expressions, but for the places of words, a cursor's walk over each text.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnwise.registry import register
from turnwise.session import materialise
from turnwise.sources.tables import oracle, table, turns

#: Accented letters of the Latin blocks that decompose to an ASCII letter, and those letters.
_ACCENTED = "".join(chr(c) for c in range(0xC0, 0x180) if unicodedata.normalize("NFKD", chr(c))[0].isascii() and unicodedata.normalize("NFKD", chr(c))[0].isalpha() and chr(c).lower() == chr(c))
_BARE = "".join(unicodedata.normalize("NFKD", c)[0].lower() for c in _ACCENTED)
#: What stands between tokens, beside the blank.
_BLANKS = "-–—_/\t\n\x0b\f\r"

#: Limits of a vocabulary term.
TERM_CHARS, TERM_WORDS, TERM_PUNCTUATION = 60, 5, "'’&.-"
#: Up to so many terms a vocabulary is broadcast; larger ones are joined.
BROADCAST_TERMS = 200_000
#: Beginnings of terms that are broadcast, at most; with more terms the beginnings are shorter.
BROADCAST_HEADS = 1_000_000


def held(rows: DataFrame, *more: Column) -> DataFrame:
    """Adds columns, all worked out once a row: as rows of a generator they are not written into the expressions that use them, which would repeat them for each item of an array."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns, *more))).alias("_row")).select("_row.*")


def letters(text: Column) -> Column:
    """Lower case without accents, bracketed marks, cut words (f~) and apostrophes; & is "and"; what is neither letter nor digit separates tokens, as a blank, or vanishes inside them."""
    # A cut word is looked for where a word or the rest of one begins, not at each of its letters.
    cut = F.regexp_replace(F.translate(text, "’'", ""), r"\([^)]*\)|(?:\G|(?<=\s))[^\s~]*+~\S*", " ")
    low = F.lower(F.when(text.contains("(") | text.contains("~"), cut).otherwise(text))
    bare = F.translate(F.replace(low, F.lit("&"), F.lit(" and ")), _ACCENTED + _BLANKS + "’'", _BARE + " " * len(_BLANKS))
    # Posix classes are looked up in a table, which [a-z0-9] is not; of A-Z none is left.
    return F.regexp_replace(bare, r"[^\p{Alnum} ]+", "")


def spoken_tokens(text: Column) -> Column:
    """The tokens of a word or text as an array; "ok" is "okay"."""
    return F.array_remove(F.split(F.regexp_replace(letters(text), r"ok(?<!\p{Alnum}ok)(?!\p{Alnum})", "okay"), " "), "")


_LETTERS = rf"""trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(translate(lower({{}}), '{_ACCENTED}’''', '{_BARE}'), '\([^)]*\)|\S*~\S*', ' ', 'g'), '&', ' and '), '[-–—_/]', ' ', 'g'), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'), ' ')"""
_TOKENS = f"list_transform(list_filter(string_split({_LETTERS}, ' '), lambda x: x <> ''), lambda x: CASE WHEN x = 'ok' THEN 'okay' ELSE x END)"


def term_key(term: Column) -> Column:
    """The identity of a term: letters alone, without accents and case."""
    return F.regexp_replace(F.translate(F.lower(term), _ACCENTED, _BARE), r"[^\p{L}]", "")


def term_problem(term: Column) -> Column:
    """Why a term is none, by the first rule that fails; null if it is one."""
    rules = [
        ("not_normalized", term != F.regexp_replace(F.trim(term), r"\s+", " ")),
        ("empty", term == ""),
        ("too_long", F.length(term) > TERM_CHARS),
        ("too_many_words", F.size(F.split(term, " ")) > TERM_WORDS),
        ("digit", term.rlike(r"\p{N}")),
        ("character", term.rlike(rf"[^\p{{L}}\p{{M}} {TERM_PUNCTUATION}]")),
        ("must_start_with_letter", ~term.rlike(r"^\p{L}")),
        ("too_few_letters", F.length(F.regexp_replace(term, r"[^\p{L}]", "")) < 2),
    ]
    out = F.lit(None).cast("string")
    for name, failed in reversed(rules):
        out = F.when(failed, name).otherwise(out)
    return out


_PROBLEM = rf"""CASE WHEN t <> regexp_replace(trim(t, ' '), '\s+', ' ', 'g') THEN 'not_normalized' WHEN t = '' THEN 'empty' WHEN length(t) > {TERM_CHARS} THEN 'too_long' WHEN len(string_split(t, ' ')) > {TERM_WORDS} THEN 'too_many_words'
 WHEN regexp_matches(t, '\p{{N}}') THEN 'digit' WHEN regexp_matches(t, '[^\p{{L}}\p{{M}} ''’&.\-]') THEN 'character' WHEN NOT regexp_matches(t, '^\p{{L}}') THEN 'must_start_with_letter' WHEN length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) < 2 THEN 'too_few_letters' END"""


@register(
    "str39_term_validity",
    f"WITH b AS (SELECT p_partkey AS item, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_name || ' ' || p_name || ' ' || p_name WHEN 3 THEN ' ' || p_type ELSE substr(p_name, 1, 1) END AS t FROM part) SELECT item, t AS term, {_PROBLEM} AS problem, regexp_replace(translate(lower(t), '{_ACCENTED}', '{_BARE}'), '[^\\p{{L}}]', '', 'g') AS key FROM b",
)
def str39_term_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, brands, long, untrimmed and one-letter terms."""
    k = F.col("p_partkey") % 5
    t = F.when(k == 0, F.col("p_name")).when(k == 1, F.col("p_brand")).when(k == 2, F.concat_ws(" ", "p_name", "p_name", "p_name")).when(k == 3, F.concat(F.lit(" "), "p_type")).otherwise(F.substring("p_name", 1, 1))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), t.alias("term")).select("item", "term", term_problem(F.col("term")).alias("problem"), term_key(F.col("term")).alias("key"))


def locate_words(text: Column, words: Column, keep_lost: bool = False) -> Column:
    """For each word its (begin, end) in the text, found after the one before; null for a word that is empty or not found there, which leaves the cursor where it is. keep_lost: such a word stands at the cursor and moves it by its length."""

    @F.arrow_udf("array<struct<begin:int,end:int>>")
    def located(texts: pa.Array, lists: pa.Array) -> pa.Array:
        begins, ends, lost, sizes = array("i"), array("i"), array("b"), array("i", [0])
        for row in range(len(lists)):
            t, at = texts[row].as_py() or "", 0
            own = lists[row].as_py() or ()
            for word in own:
                token = (word or "").strip(" ")
                found = t.find(token, at) if token else -1
                begin = at if found < 0 else found
                begins.append(begin)
                ends.append(begin + len(token))
                lost.append(found < 0 and not keep_lost)
                if found >= 0 or keep_lost:
                    at = begin + len(token)
            sizes.append(sizes[-1] + len(own))
        places = pa.StructArray.from_arrays([pa.array(np.array(x, np.int32)) for x in (begins, ends)], ["begin", "end"], mask=pa.array(np.array(lost, bool)))
        return pa.ListArray.from_arrays(pa.array(np.array(sizes, np.int32)), places, mask=lists.is_null())

    return located(text, words)


#: What a recogniser lists as the words of a text: letters and digits with inner marks, no other punctuation.
WORDS = r"[\p{L}\p{N}][\p{L}\p{N}'’&-]*"
_WORDS_SQL = WORDS.replace("'", "''")


@register(
    "jn21_cursor_alignment",
    oracle(
        rf""", w AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '{_WORDS_SQL}') AS ws FROM turns)
        , c AS (SELECT conv_id, turn, lower(text) AS t, list_transform(ws, lambda x, i: CASE WHEN i % 7 = 0 THEN x || '#' ELSE x END) AS ws FROM w)
        , r(conv_id, turn, t, ws, i, pos, b) AS (
          SELECT conv_id, turn, t, ws, 0, 0, NULL::INTEGER FROM c
          UNION ALL SELECT conv_id, turn, t, ws, i + 1, CASE WHEN p > 0 THEN pos + p - 1 + length(ws[i + 1]) ELSE pos END, CASE WHEN p > 0 THEN pos + p - 1 END
          FROM (SELECT *, instr(substr(t, pos + 1), ws[i + 1]) AS p FROM r WHERE i < len(ws))
        )
        SELECT conv_id, turn, CAST(max(i) AS BIGINT) AS n_words, CAST(count(b) AS BIGINT) AS located, CAST(coalesce(sum(b), 0) AS BIGINT) AS begins, CAST(max(pos) AS BIGINT) AS cursor FROM r GROUP BY 1, 2"""
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def jn21_cursor_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each turn in its text in order; every seventh is spelled so that it is not there."""
    t = turns(spark, sf_dir).select("conv_id", "turn", F.lower("text").alias("t"))
    words = F.transform(F.regexp_extract_all("t", F.lit(WORDS), 0), lambda x, i: F.when((i + 1) % 7 == 0, F.concat(x, F.lit("#"))).otherwise(x))
    found = t.select("conv_id", "turn", words.alias("ws"), "t").select("conv_id", "turn", "ws", locate_words(F.col("t"), F.col("ws")).alias("places"))
    begins = F.aggregate("places", F.lit(0).cast("bigint"), lambda a, p: a + F.coalesce(p["begin"], F.lit(0)))
    cursor = F.aggregate("places", F.lit(0), lambda a, p: F.coalesce(p["end"], a))
    located = F.size(F.filter("places", lambda p: p.isNotNull()))
    return found.select("conv_id", "turn", F.size("ws").cast("bigint").alias("n_words"), located.cast("bigint").alias("located"), begins.alias("begins"), cursor.cast("bigint").alias("cursor"))


def vocabulary(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """(term, rank, key, n_tokens, tokens) of distinct terms with letters; rank: the order among terms of one length."""
    t = terms.select(F.col(term_col).alias("term")).distinct().withColumn("tokens", spoken_tokens(F.col("term")))
    return t.select("term", F.array_join("tokens", "").alias("key"), F.size("tokens").alias("n_tokens"), "tokens").where("key <> ''")


def first_come(spans: DataFrame, keys: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """The spans that a scan in the given order takes: each that begins at or after the end of the last one taken.

    Spans that overlap in a chain form an island; islands are found by a running maximum and
    scanned each by itself, in a fold over its few spans. `order` begins with `start`.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    reached = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("_new", F.when(F.col(start) < reached, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(by)).drop("_new")
    rest = [c for c in spans.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    listed = islands.groupBy(*keys, "_island").agg(F.sort_array(F.collect_list(F.struct(*ordered))).alias("_all"))
    kind = listed.schema["_all"].dataType.simpleString()
    begin = F.struct(F.lit(None).cast(dict(spans.dtypes)[end]).alias("end"), F.array().cast(kind).alias("taken"))
    take = lambda acc, x: F.when(acc["end"].isNull() | (x[start] >= acc["end"]), F.struct(x[end].alias("end"), F.array_append(acc["taken"], x).alias("taken"))).otherwise(acc)
    return listed.select(*keys, F.explode(F.aggregate("_all", begin, take)["taken"]).alias("_x")).select(*keys, *[F.col("_x")[c].alias(c) for c in rest])


def turn_ends(units: DataFrame, unit: str, turn: str, column: str, longest: int) -> DataFrame:
    """(unit, turn, n, offset, tail, later), written, of turns that have items in an array column: their number and that of the turns before, the last items, and the first ones of the turns after, as many of both as a run of `longest` that crosses turns can have."""
    few, n = max(longest - 1, 1), F.size("own")
    cut = units.select(unit, turn, F.col(column).alias("own")).where(n > 0).select(unit, turn, n.cast("bigint").alias("n"), F.slice("own", 1, few).alias("head"), F.slice("own", F.greatest(n - few, F.lit(0)) + 1, F.lit(few)).alias("tail"))
    by = Window.partitionBy(unit).orderBy(turn)
    later = F.slice(F.flatten(F.collect_list("head").over(by.rowsBetween(1, few))), 1, few)
    offset = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return materialise(cut.select(unit, turn, "n", offset.alias("offset"), "tail", later.alias("later")), "turn-ends")


def _runs_of(rows: DataFrame, items: str, longest: int, join: Callable[[Column, Column], Column], opens: Callable[[DataFrame, Column, Column], DataFrame] | None = None) -> DataFrame:
    """Each run of 1 to `longest` of a row's items, joined from the left: the row's other columns, first, size, key. opens: keeps of all places those where a run is wanted, by the item there and the next one."""
    rest = [c for c in rows.columns if c != items]
    shifted = [F.slice(items, F.lit(k + 1), F.size(items)) for k in range(longest)]
    x = rows.select(*rest, F.posexplode(F.arrays_zip(*shifted)).alias("first", "x"))
    if opens and longest > 1:
        x = opens(x, F.col("x")["0"], F.col("x")["1"]).select(*rest, "first", "x")
    runs = [F.col("x")["0"]]
    for k in range(1, longest):
        more = F.col("x")[str(k)]
        runs.append(F.when(runs[-1].isNotNull() & more.isNotNull(), join(runs[-1], more)))
    sized = F.array(*[F.struct(F.lit(k + 1).alias("size"), run.alias("key")) for k, run in enumerate(runs)])
    return x.select(*rest, "first", F.explode(sized).alias("r")).select(*rest, "first", "r.size", "r.key").where("key IS NOT NULL")


def token_runs(units: DataFrame, ends: DataFrame | None, unit: str, turn: str, column: str, longest: int, join: Callable[[Column, Column], Column], opens: Callable[[DataFrame, Column, Column], DataFrame] | None = None) -> DataFrame:
    """(unit, turn, first, size, key): every run of 1 to `longest` items of an array column, joined pairwise from the left; first: its place in its turn.

    Runs inside a turn come from its row alone; those that cross turns from `ends` (None: units have one turn each), so no whole turn is shuffled.
    opens: as of `_runs_of`; all runs of the places that it keeps.
    """
    inside = _runs_of(units.select(unit, turn, F.col(column).alias("own")), "own", longest, join, opens).select(unit, turn, "first", "size", "key")
    if ends is None or longest < 2:
        return inside
    border = ends.where(F.size("later") > 0).select(unit, turn, "n", F.size("tail").alias("m"), F.concat("tail", "later").alias("own"))
    crossing = _runs_of(border, "own", longest, join, opens).where("first < m AND first + size > m")
    return inside.unionByName(crossing.select(unit, turn, (F.col("n") - F.col("m") + F.col("first")).cast("int").alias("first"), "size", "key"))


def term_openings(vocab: DataFrame, terms: int) -> Callable[[DataFrame, Column, Column], DataFrame]:
    """Keeps the places where a term may begin: the token there is a key, or with the next one the beginning of a key, which few are; the rest need no runs."""
    n = max(BROADCAST_HEADS // max(terms, 1), 1)
    cut = F.least(F.length("key"), F.lit(n))
    whole = F.col("i") == cut
    heads = vocab.select("key", F.explode(F.sequence(F.lit(1), cut)).alias("i")).groupBy(F.left("key", F.col("i")).alias("_head")).agg(F.max(whole).alias("_whole"))

    def opens(places: DataFrame, token: Column, after: Column) -> DataFrame:
        begun = places.join(F.broadcast(heads), F.left(token, F.lit(n)) == F.col("_head"))
        longer = heads.select(F.col("_head").alias("_longer"))
        return begun.join(F.broadcast(longer), F.left(F.concat(token, after), F.lit(n)) == F.col("_longer"), "left").where("_whole OR _longer IS NOT NULL")

    return opens


def term_hits(units: DataFrame, vocab: DataFrame, unit: str, turn: str, tokens: str = "tokens", one_turn: bool = False) -> DataFrame:
    """(unit, turn, first, size, term) of the hits of a vocabulary, those that the scan takes.

    units: one row for each turn with its array of tokens; one_turn: units have one each. first: the
    place of the first token in its turn; size: tokens, at most one more than the term has.
    """
    vocab = materialise(vocab, "vocabulary")
    most, terms = vocab.agg(F.max("n_tokens"), F.count("*")).first()
    longest = (most or 0) + 1
    ends = None if one_turn else turn_ends(units, unit, turn, tokens, longest)
    small = terms <= BROADCAST_TERMS
    runs = token_runs(units, ends, unit, turn, tokens, longest, lambda a, b: F.concat(a, b), term_openings(vocab, terms) if small else None)
    met = runs.join(F.broadcast(vocab) if small else vocab, "key").where(F.col("size") <= F.col("n_tokens") + 1)
    # At one place the longer term is first, then the earlier one by name; of one term the fewer tokens.
    best = F.min_by(F.struct("size", "term"), F.struct(-F.length("key"), F.col("term"), F.col("size")))
    starts = met.groupBy(unit, turn, "first").agg(best.alias("b")).select(unit, turn, "first", "b.*")
    starts = starts.withColumn("offset", F.lit(0)) if ends is None else starts.join(ends.select(unit, turn, "offset"), [unit, turn])
    begin = F.col("offset") + F.col("first")
    taken = first_come(starts.select(unit, turn, "first", "size", "term", begin.alias("start"), (begin + F.col("size")).alias("end")), [unit], "start", "end", ["start"])
    return taken.select(unit, turn, "first", "size", "term")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names, and of every reference phrase its second and third word as one and its fourth and fifth as two."""
    w = F.split("text", " ")
    b = table(spark, sf_dir, "benchmark").where(F.size(w) >= 5)
    pair = lambda i, mark: F.array_join(F.slice(w, i, 2), mark)
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("term")).unionByName(b.select(F.explode(F.array(pair(2, ""), pair(4, " "))).alias("term"))).distinct()


_VOCABULARY = f"""terms AS (
  SELECT DISTINCT term FROM (SELECT p_name AS term FROM part UNION ALL SELECT unnest([w[2] || w[3], w[4] || ' ' || w[5]]) FROM (SELECT string_split(text, ' ') AS w FROM benchmark) WHERE len(w) >= 5)
), vocab AS (
  SELECT term, array_to_string(tokens, '') AS key, len(tokens) AS n_tokens FROM (SELECT term, {_TOKENS.format("term")} AS tokens FROM terms) WHERE len(tokens) > 0
)"""


@register(
    "str12_term_scan",
    f"""WITH RECURSIVE {_VOCABULARY}, toks AS (
      SELECT doc_id, {_TOKENS.format("text")} AS t FROM documents
    ), runs AS (
      SELECT doc_id, first, size, array_to_string(t[first + 1:first + size], '') AS key, len(t) AS n
      FROM (SELECT doc_id, t, unnest(range(len(t))) AS first FROM toks), (SELECT unnest(range(1, (SELECT max(n_tokens) + 2 FROM vocab))) AS size)
    ), best AS (
      SELECT doc_id, first, arg_min(struct_pack(size := size, term := term), struct_pack(a := -length(key), b := term, c := size)) AS b
      FROM runs JOIN vocab USING (key) WHERE first + size <= n AND size <= n_tokens + 1 GROUP BY ALL
    ), c AS (
      SELECT doc_id, first, b.size AS size, b.term AS term FROM best
    ), scan(doc_id, first, size, term) AS (
      SELECT doc_id, min(first), arg_min(size, first), arg_min(term, first) FROM c GROUP BY doc_id
      UNION ALL SELECT s.doc_id, min(c.first), arg_min(c.size, c.first), arg_min(c.term, c.first) FROM scan s JOIN c ON c.doc_id = s.doc_id AND c.first >= s.first + s.size GROUP BY s.doc_id, s.first
    ) SELECT doc_id, CAST(first AS INTEGER) AS first, CAST(size AS INTEGER) AS size, term FROM scan""",
)
def str12_term_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit of the vocabulary in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("turn"), spoken_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return term_hits(docs, vocabulary(_terms(spark, sf_dir)), "doc_id", "turn", one_turn=True).select("doc_id", "first", "size", "term")


def merge_terms(units: DataFrame, vocab: DataFrame, unit: str, turn: str, words: int = 1) -> DataFrame:
    """(unit, turn, text, words, hits) of every turn with its accepted hits written as the vocabulary has them.

    units: unit, turn, text, words (array of word, start, end). hits: term, status, heard, char_begin
    and char_end in the new text, word_begin and word_end in the new words, start and end. status:
    already_correct (the tokens are the term's), rule (the number of words differs by more than
    `words`; letters and so sound are equal), crosses_turn, unlocated (a word is not found in the
    text after the one before, or something stands between two of them), overlap (a word belongs
    to an earlier hit), accepted. Marks before the first word and after the last stay. The
    term's words share the time of the words that they replace.
    """
    by_word = F.transform("words", lambda w: spoken_tokens(w["word"]))
    owners = F.flatten(F.transform("by_word", lambda ts, i: F.transform(ts, lambda _: i)))
    rows = held(units.select(unit, turn, "text", "words"), by_word.alias("by_word"))
    rows = held(rows, F.flatten("by_word").alias("tokens"), owners.alias("owners")).drop("by_word")
    hits = term_hits(rows, vocab, unit, turn).join(vocab.select("term", F.col("tokens").alias("own")), "term")
    hits = hits.groupBy(unit, turn).agg(F.sort_array(F.collect_list(F.struct("first", "size", "term", "own"))).alias("found"))
    rows = rows.join(hits, [unit, turn], "left")
    rows = held(rows, locate_words(F.col("text"), F.when(F.col("found").isNotNull(), F.transform("words", lambda w: w["word"]))).alias("places"))
    text, places, ws = F.col("text"), F.col("places"), F.col("words")

    def spot(h: Column) -> Column:
        a, b = F.get("owners", h["first"]), F.get("owners", h["first"] + h["size"] - 1)
        return F.struct(h["term"].alias("term"), a.alias("a"), F.coalesce(b, F.size("words")).alias("b"), (h["first"] + h["size"] > F.size("tokens")).alias("crosses"), (F.slice("tokens", h["first"] + 1, h["size"]) == h["own"]).alias("correct"), (F.abs(h["size"] - F.size(h["own"])) > words).alias("far"))

    def apart(h: Column) -> Column:
        inside = F.sequence(h["a"], F.greatest(h["a"], h["b"] - 1))
        gap = lambda i: F.trim(F.substring(text, places[i]["end"] + 1, places[i + 1]["begin"] - places[i]["end"])) != ""
        lost = F.exists(F.slice("places", h["a"] + 1, h["b"] - h["a"] + 1), lambda p: p.isNull())
        return lost | ((h["a"] < h["b"]) & F.exists(inside, gap))

    def judge(acc: Column, h: Column) -> Column:
        status = F.when(h["correct"], "already_correct").when(h["far"], "rule").when(h["crosses"], "crosses_turn").when(apart(h), "unlocated").when(h["a"] <= acc["last"], "overlap").otherwise("accepted")
        judged = F.struct(*[h[c].alias(c) for c in ("term", "a", "b")], status.alias("status"))
        return F.struct(F.when(status == "accepted", h["b"]).otherwise(acc["last"]).alias("last"), F.array_append(acc["hits"], judged).alias("hits"))

    none = F.array().cast("array<struct<term:string,a:int,b:int,status:string>>")
    judged = F.aggregate(F.transform(F.coalesce("found", F.array().cast(rows.schema["found"].dataType.simpleString())), spot), F.struct(F.lit(-1).alias("last"), none.alias("hits")), judge)["hits"]
    rows = held(rows, judged.alias("judged"))

    # Each accepted hit: the stretch of text and words that it replaces, and what it writes there.
    def written(h: Column) -> Column:
        begin, end = places[h["a"]]["begin"], places[h["b"]]["end"]
        lead = F.length(F.regexp_extract(ws[h["a"]]["word"], r"^[^\p{L}\p{N}_]*", 0))
        trail = F.when((h["a"] == h["b"]) & (lead == F.length(F.trim(ws[h["a"]]["word"]))), 0).otherwise(F.length(F.regexp_extract(ws[h["b"]]["word"], r"[^\p{L}\p{N}_]*$", 0)))
        heard = F.substring(text, begin + 1, end - begin)
        return F.struct(h["term"].alias("term"), h["a"].alias("a"), h["b"].alias("b"), (begin + lead).alias("begin"), (end - trail).alias("end"), heard.alias("heard"), ws[h["a"]]["start"].alias("start"), F.greatest(ws[h["a"]]["start"], ws[h["b"]]["end"]).alias("stop"), F.substring(heard, F.lit(1), lead).alias("lead"), F.right(heard, trail).alias("trail"))

    rows = held(rows, F.transform(F.filter("judged", lambda h: h["status"] == "accepted"), written).alias("put"))
    before = lambda i, c, otherwise: F.when(i > 0, F.get("put", i - 1)[c]).otherwise(otherwise)
    pieces = F.transform("put", lambda h, i: F.concat(F.substring(text, before(i, "end", 0) + 1, h["begin"] - before(i, "end", 0)), h["term"]))
    last = F.element_at(F.col("put"), -1)
    merged = F.concat(F.array_join(pieces, ""), F.substring(text, last["end"] + 1, F.length(text)))

    def spread(h: Column) -> Column:
        parts = F.split(h["term"], " ")
        step = (h["stop"] - h["start"]) / F.size(parts)
        label = lambda p, i: F.concat(F.when(i == 0, h["lead"]).otherwise(""), p, F.when(i == F.size(parts) - 1, h["trail"]).otherwise(""))
        return F.transform(parts, lambda p, i: F.struct(label(p, i).alias("word"), (h["start"] + step * i).alias("start"), (h["start"] + step * (i + 1)).alias("end")))

    plain = lambda part: F.transform(part, lambda w: F.struct(w["word"].alias("word"), w["start"].cast("double").alias("start"), w["end"].cast("double").alias("end")))
    runs = F.transform("put", lambda h, i: F.concat(plain(F.slice("words", before(i, "b", -1) + 2, h["a"] - before(i, "b", -1) - 1)), spread(h)))
    rest = plain(F.slice("words", F.coalesce(last["b"], F.lit(-1)) + 2, F.size("words")))

    longer = lambda h: F.length(h["term"]) - (h["end"] - h["begin"])
    more = lambda h: F.size(F.split(h["term"], " ")) - (h["b"] - h["a"] + 1)
    moved = lambda i, by: F.aggregate(F.slice("put", F.lit(1), i), F.lit(0), lambda a, h: a + by(h))
    report = lambda term, status, heard=None, cb=None, ce=None, wb=None, we=None, start=None, end=None: F.struct(term.alias("term"), status.alias("status"), *[(F.lit(None) if x is None else x).cast(kind).alias(n) for n, x, kind in (("heard", heard, "string"), ("char_begin", cb, "int"), ("char_end", ce, "int"), ("word_begin", wb, "int"), ("word_end", we, "int"), ("start", start, "double"), ("end", end, "double"))])
    done = F.transform("put", lambda h, i: report(h["term"], F.lit("accepted"), h["heard"], h["begin"] + moved(i, longer), h["begin"] + moved(i, longer) + F.length(h["term"]), h["a"] + moved(i, more), h["a"] + moved(i, more) + F.size(F.split(h["term"], " ")), h["start"], h["stop"]))
    others = F.transform(F.filter("judged", lambda h: h["status"] != "accepted"), lambda h: report(h["term"], h["status"]))
    any_put = F.size("put") > 0
    return rows.select(unit, turn, F.when(any_put, merged).otherwise(text).alias("text"), F.when(any_put, F.concat(F.flatten(runs), rest)).otherwise(plain(F.col("words"))).alias("words"), F.concat(done, others).alias("hits"))


def timed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their words, which share the turn's time evenly."""
    t = held(turns(spark, sf_dir).select("conv_id", "turn", "text", "start_ds", "end_ds"), F.regexp_extract_all("text", F.lit(WORDS), 0).alias("ws"))
    step = (F.col("end_ds") - F.col("start_ds")) / F.greatest(F.size("ws"), F.lit(1)) / 10
    words = F.transform("ws", lambda w, i: F.struct(w.alias("word"), (F.col("start_ds") / 10 + step * i).alias("start"), (F.col("start_ds") / 10 + step * (i + 1)).alias("end")))
    return t.select("conv_id", "turn", "text", words.alias("words"))


@register("str15_replacements")
def str15_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit of the vocabulary in the conversations, with its place in the merged turn or the reason why it is none."""
    m = merge_terms(timed_words(spark, sf_dir), vocabulary(_terms(spark, sf_dir)), "conv_id", "turn")
    return m.select("conv_id", "turn", F.explode("hits").alias("h")).select("conv_id", "turn", "h.term", "h.status", "h.heard", "h.char_begin", "h.char_end", "h.word_begin", "h.word_end", F.round("h.start", 6).alias("start"), F.round("h.end", 6).alias("end"))
