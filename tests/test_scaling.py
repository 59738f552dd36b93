"""Steps whose work must follow their input: nothing of a whole row is worked out again for each item of it."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from turnwise.functions import vocabulary as v


def lambdas_with(df, name: str) -> list[str]:
    """The bodies of array functions in the optimized plan that call a function."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in re.findall(r"lambdafunction\([^\n]*", plan) if name in x]


def test_a_turns_words_are_extracted_once(spark, sf_dir):
    words = v.timed_words(spark, sf_dir)
    assert not lambdas_with(words.select(F.transform("words", lambda w: w["start"])), "regexp_extract_all")


def test_a_term_crosses_a_turn_without_tokens(spark):
    units = spark.createDataFrame([(1, 0, ["say", "silver"]), (1, 1, []), (1, 2, ["brook", "now"]), (2, 0, ["brook"])], "unit int, turn int, tokens array<string>")
    vocab = v.vocabulary(spark.createDataFrame([("Silverbrook",)], "term string"))
    assert [tuple(r) for r in v.term_hits(units, vocab, "unit", "turn").collect()] == [(1, 0, 1, 2, "Silverbrook")]


def test_hashing_shuffles_nothing(spark, sf_dir):
    from turnwise.functions.vectors import fn12_hashing_embedder

    assert "Exchange" not in fn12_hashing_embedder(spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in fn12_hashing_embedder(spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()


def test_picks_are_ranked_without_a_group_in_python(spark):
    from turnwise.operators import evaluation as e

    team = [("ann", 2, 1.0), ("bo", 0, 2.0), ("cy", 1, 0.0)]
    items = spark.createDataFrame([(1, i) for i in range(25)] + [(2, 0)], "team long, item long")
    got = e.least_outstanding(items, spark.createDataFrame([(t, *r) for t in (1, 2) for r in team], "team long, reviewer string, pending long, weight double"), "team", ["item"])
    assert "Pandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r["reviewer"] for r in got.where("team = 1").orderBy("item").collect()] == e.assign(25, team)
    assert [r["reviewer"] for r in got.where("team = 2").collect()] == e.assign(1, team)


def test_a_calls_turns_reach_the_checks_as_one_row(spark, sf_dir):
    from turnwise.plans.phrases import str07_phrase_rules

    assert "FlatMapGroups" not in str07_phrase_rules(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_only_days_that_can_matter_are_looked_at(spark, sf_dir):
    from turnwise.functions.schedules import ses09_schedule_occurrences

    assert "sequence(-8" not in ses09_schedule_occurrences(spark, sf_dir)._jdf.queryExecution().analyzed().toString()


def test_values_are_looked_for_once_a_text(spark):
    from turnwise.functions import readouts as r

    df = spark.createDataFrame([("Jo's card: 12, jo 123", ["jo", "12", ""]), (None, ["x"]), ("plain", [])], "t string, v array<string>")
    got = df.select(r.mask_words(F.col("t"), F.col("v")).alias("w"))
    assert not lambdas_with(got, "regexp_replace")
    assert [x["w"] for x in got.collect()] == [["[REDACTED]", "card:", "[REDACTED]", "[REDACTED]", "[REDACTED]"], None, ["plain"]]


def test_number_tokens_search_a_text_once(spark):
    from turnwise.functions import readouts as r

    text = "é" * 900 + " code one two, 12"
    rows = spark.createDataFrame([(1, text, "said before"), (2, "no number", ""), (3, "seven", "x" * 500)], "id int, text string, context string")
    got = r.number_tokens(rows, ["id"])
    assert "RLIKE" not in got._jdf.queryExecution().analyzed().toString().split("Generate")[-1]
    for t in got.collect():
        lead, own = {1: ("said before ", text), 3: ("x" * 200 + " ", "seven")}[t["id"]]
        assert t["before"] == (lead + own[: t["begin"]])[-400:]
    assert sorted(t["value"] for t in got.collect()) == ["12", "one", "seven", "two"]


def test_tokens_take_no_lambda_and_one_table_of_letters(spark):
    df = spark.createDataFrame([("Ok\x0bO'Neil & (um) f~ book-OK  ök é9'’(x ~y) ok",), ("\t’(\u2028~)Ok",), ("((((",), (None,)], "t string").select(v.spoken_tokens(F.col("t")).alias("w"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "a-z0-9" not in plan
    assert [r["w"] for r in df.collect()] == [["okay", "oneil", "and", "book", "okay", "okay", "e9", "okay"], ["okay"], [], None]


def test_runs_are_made_where_a_term_may_begin(spark, monkeypatch):
    said = ["the", "sil", "ver", "brook", "silver", "lake", "brooks", "oak", "sil", "of"]
    units = spark.createDataFrame([(1, 0, said)], "unit int, turn int, tokens array<string>")
    vocab = v.vocabulary(spark.createDataFrame([("Silver Brook",), ("Oak",)], "term string"))
    opens = v.term_openings(vocab, 2)
    runs = v.token_runs(units, None, "unit", "turn", "tokens", 3, lambda a, b: F.concat(a, b), opens)
    assert {r["first"] for r in runs.collect()} == {1, 7}
    for most in (1_000_000, 6, 1):  # all beginnings, those of three letters, first letters
        monkeypatch.setattr(v, "BROADCAST_HEADS", most)
        hits = v.term_hits(units, vocab, "unit", "turn", one_turn=True).collect()
        assert sorted((r["first"], r["size"], r["term"]) for r in hits) == [(1, 3, "Silver Brook"), (7, 1, "Oak")]
    assert v.term_hits(units, vocab.limit(0), "unit", "turn", one_turn=True).count() == 0


def test_a_texts_tokens_are_worked_out_once(spark, sf_dir):
    plan = v.str12_term_scan(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("okay") == 1
