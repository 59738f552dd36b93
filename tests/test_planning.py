"""Mute intervals, speech runs, rerun plans and waves over graphs: literal cases and brute force."""

from __future__ import annotations

import random

import pytest

from turnwise.operators.graph import MODELS, STAGES, nearest_seed, plan_rerun
from turnwise.operators.mutes import mute_intervals, speech_runs

ROW = "unit string, text string, start double, end double, words array<struct<word:string,start:double,end:double>>, spans array<struct<begin:int,end:int,by_place:boolean>>, entities array<struct<start:double,end:double>>"


def words(text, first=0.0, untimed=()):
    return [(w, None if i in untimed else first + i, first + i + 1) for i, w in enumerate(text.split())]


def muted(spark, *rows):
    got = mute_intervals(spark.createDataFrame(list(rows), ROW), "unit", 0.1).orderBy("unit", "start").collect()
    return [(r.unit, round(r.start, 3), round(r.end, 3)) for r in got]


@pytest.mark.parametrize(
    ("spans", "change", "want"),
    [
        ([(10, 14, False)], {}, [(2.9, 5.1)]),  # "4821 no" touches two words
        ([(10, 12, True)], {}, [(2.9, 4.1)]),
        ([(3, 5, False), (10, 12, False)], {}, [(0.9, 2.1), (2.9, 4.1)]),
        ([(3, 6, False), (6, 12, True)], {}, [(0.9, 4.1)]),  # touching spans are one
        ([(10, 12, True)], {"untimed": (3,)}, [(0.0, 6.1)]),  # for its place and without a timed word: the whole turn
        ([(10, 12, False), (3, 5, False)], {"untimed": (3,)}, [(0.9, 2.1)]),  # for its value: what is aligned
        ([(10, 12, False)], {"untimed": (3,)}, [(0.0, 6.1)]),
        ([(10, 12, True)], {"words": []}, [(0.0, 6.1)]),
        ([(10, 12, True)], {"words": [], "end": None}, []),
        ([(10, 12, False)], {"words": [], "entities": [(2.0, 2.5)]}, [(1.9, 2.6)]),
        ([(10, 12, False)], {"entities": [(2.0, None), (5.0, 5.5)]}, [(2.9, 4.1), (4.9, 5.6)]),
        ([(5, 5, True), (-1, 4, True), (3, 99, True)], {}, []),  # no such spans
        ([], {}, []),
        (None, {}, []),
    ],
)
def test_mutes(spark, spans, change, want):
    text = "pin is is 48 21 no"  # words begin at 0, 4, 7, 10, 13, 16
    row = ("u", text, 0.0, change.get("end", 6.0), change.get("words", words(text, untimed=change.get("untimed", ()))), spans, change.get("entities"))
    assert [(a, b) for _, a, b in muted(spark, row)] == want


def test_mutes_of_a_unit_are_one_union_and_lost_words_stand_at_the_search(spark):
    a = ("u", "one two", 0.0, 2.0, words("one two"), [(4, 7, False)], None)
    b = ("u", "three four", 2.0, 4.0, words("three four", 2.0), [(0, 5, False)], None)
    c = ("v", "ab cd", 0.0, 2.0, [("zz", 0.0, 1.0), ("cd", 1.0, 2.0)], [(0, 2, True)], None)
    assert muted(spark, a, b, c) == [("u", 0.9, 3.1), ("v", 0.0, 1.1)]


def brute_runs(energies, floor, hangover, least):
    limit = max(floor, sorted(energies)[int(len(energies) * 0.15)] * 2.5)
    out, begin, quiet = [], None, 0
    for i, e in enumerate([*energies, *[0] * max(hangover, 1)]):
        if e >= limit and i < len(energies):
            begin, quiet = (i if begin is None else begin), 0
        elif begin is not None:
            quiet += 1
            if quiet >= hangover:
                if i + 1 - quiet - begin >= least:
                    out.append((begin, i + 1 - quiet))
                begin, quiet = None, 0
    return out


@pytest.mark.parametrize(("hangover", "least"), [(0, 1), (1, 1), (3, 2), (5, 4)])
def test_speech_runs_against_a_loop(spark, hangover, least):
    rng = random.Random(hangover)
    channels = {c: [rng.choice([1.0, 1.0, 2.0, 9.0, 14.0, 30.0]) for _ in range(n)] for c, n in enumerate((1, 2, 7, 60, 200))}
    rows = [(c, i, e) for c, es in channels.items() for i, e in enumerate(es)]
    rng.shuffle(rows)
    got = speech_runs(spark.createDataFrame(rows, "c int, i int, e double"), "c", "i", "e", 8.0, hangover, least).collect()
    for c, es in channels.items():
        assert sorted((r.begin, r.end) for r in got if r.c == c) == brute_runs(es, 8.0, hangover, least)


def test_rerun_plan(spark):
    rows = []
    for item, changes in {"same": {}, "cat": {"categorize": ("a", "b")}, "limit": {"thresholds": ("a", "b")}, "sub": {"subcategorize": ("a", "b")}, "first": {"categorize": (None, "b"), "extract": (None, "b")}, "end": {"extract": ("a", "b")}}.items():
        rows += [(item, s, *changes.get(s, ("a", "a"))) for s in ("categorize", "thresholds", "subcategorize", "extract")]
    rows.append(("gone", "categorize", "a", None))  # a stage that is no more is not stale
    got = {r.item: (r.run, r.rederive, r.reasons) for r in plan_rerun(spark.createDataFrame(rows, "item string, stage string, old string, new string"), "item", STAGES, MODELS).collect()}
    all_models = ["categorize", "subcategorize", "extract"]
    assert got == {
        "same": ([], [], []),
        "cat": (all_models, ["spans", "merge"], ["categorize:changed"]),
        "limit": (["subcategorize", "extract"], ["thresholds", "spans", "merge"], ["thresholds:changed"]),
        "sub": (["subcategorize", "extract"], ["merge"], ["subcategorize:changed"]),
        "first": (all_models, ["spans", "merge"], ["categorize:new", "extract:new"]),
        "end": (["extract"], ["merge"], ["extract:changed"]),
        "gone": ([], [], []),
    }


def test_waves_reach_the_nearest_seed_and_end_in_cycles(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (3, 9), (1, 4), (7, 6), (8, 8)], "job int, upstream int")
    seeds = spark.createDataFrame([(1, 5), (9, 7), (8, 1)], "job int, rank int")
    assert sorted(map(tuple, nearest_seed(edges, seeds, ["rank"]).collect())) == [(1, 9, 3), (2, 1, 1), (3, 9, 1), (4, 9, 2), (8, 8, 1)]
    assert nearest_seed(edges, seeds.where("false"), []).count() == 0
