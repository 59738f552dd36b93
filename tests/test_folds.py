"""Literal cases of the folds that SQL cannot say."""

from __future__ import annotations

import pytest

from turnwise.operators import evaluation, feeds, segments
from turnwise.plans import phrases


@pytest.mark.parametrize(("seconds", "n"), [(0, 1), (7.0, 1), (7.0004, 1), (7.01, 2), (14.0, 2), (21.5, 4)])
def test_window_count(seconds, n):
    assert segments.window_count(seconds) == n


def test_placeholders_map_places():
    raw, masked = "my pin is 4492 and that is all", "my pin is [REDACTED] and that is all"
    assert segments.placeholders(raw, masked) == [(10, 14, 10, 20)]
    spans = segments.placeholders(raw, masked)
    assert segments.masked_place(12, spans, "start") == 10 and segments.masked_place(12, spans, "end") == 20
    assert segments.masked_place(15, spans, "start") == 21 and segments.masked_place(3, spans, "end") == 3
    assert segments.placeholders(raw, raw) == [] and segments.placeholders(raw, "something else") is None


def test_cuts_prefer_sentences_then_pauses():
    gaps = [(6.0, 0.1, False, True), (6.5, 0.9, False, True), (7.4, 0.1, True, True), (12.0, 0.0, False, True)]
    assert segments.cuts(gaps, 0, 14, 2) == [2]
    assert segments.cuts([(g[0], g[1], False, g[3]) for g in gaps], 0, 14, 2) == [1]
    assert segments.cuts([(g[0], g[1], g[2], i == 3) for i, g in enumerate(gaps)], 0, 14, 2) == [3]


def test_short_pieces_join_the_smaller_neighbour():
    assert segments.join_short([2, 5, 3]) == [7, 3]
    assert segments.join_short([5, 1, 4]) == [5, 5]
    assert segments.join_short([4, 1, 4]) == [5, 4]
    assert segments.join_short([1]) == [1]


def test_segments_cover_a_turn():
    text = " ".join(f"word{i}" + ("." if i % 9 == 8 else "") for i in range(60))
    pieces = segments.segment_turn(text, text.replace("word30", "[REDACTED]"), 3.2, 30.0)
    masked = text.replace("word30", "[REDACTED]")
    assert [p[0] for p in pieces] == list(range(len(pieces))) and len(pieces) == 4
    assert all(masked[p[1] : p[2]] == p[3] for p in pieces)
    assert " ".join(p[3] for p in pieces) == masked
    assert pieces[0][4] == 3.2 and pieces[-1][5] == 30.0
    stamped = segments.segment_turn("one two three four", "one two three four", 0, 4, [("one", 0.5, 0.9), ("three", 2, 2.4), ("four", 3, 3.5)])
    assert [(p[4], p[5], p[6]) for p in stamped] == [(0.5, 3.5, "words")]


def test_phrases():
    call = [(0, "AGENT", "Thank you for caling, how can I help?"), (1, "CALLER", "I want to cancel my account"), (2, "AGENT", "I am happy to help"), (3, "AGENT", "goodbye")]
    ask = lambda kind, *p, **kw: phrases.judge(call, phrases.PhraseCheck("c", kind, p, **kw))
    assert ask("any", "thank you for calling")[0] == "PASS" and ask("any", "thank you for calling")[3] == 0
    assert ask("any", "guaranteed return") == ("FAIL", 0.95, None, None)
    assert ask("all", "goodbye", "happy to help") == ("PASS", 0.99, "happy to help", 2) or ask("all", "goodbye", "happy to help")[0] == "PASS"
    assert ask("all", "goodbye", "guaranteed return")[0] == "FAIL"
    assert ask("none", "goodbye")[:2] == ("FAIL", 0.99) and ask("none", "guaranteed return")[:2] == ("PASS", 0.95)
    assert ask("response", "happy to help", triggers=("cancel my account",))[:2] == ("PASS", 0.99)
    assert ask("response", "goodbye then now", triggers=("cancel my account",))[0] == "FAIL"
    assert ask("response", "happy to help", triggers=("speak to a lawyer",)) == ("PASS", 0.90, None, None)
    assert phrases.best_window([], "x", 80) is None


def test_speaker_errors():
    swap = [(0, "a", 0, 5), (0, "b", 5, 10), (1, "x", 5, 10), (1, "y", 0, 5)]
    assert evaluation.speaker_errors(swap, 10)["der"] == 0
    half = [(0, "a", 0, 20), (1, "x", 0, 10), (1, "y", 10, 20)]
    got = evaluation.speaker_errors(half, 20)
    assert got["der"] == 0.5 and got["confused"] == 10
    mixed = [(0, "a", 0, 10), (0, "b", 5, 10), (1, "x", 0, 8), (1, "y", 12, 15)]
    got = evaluation.speaker_errors(mixed, 15)
    assert (got["reference"], got["missed"], got["false"]) == (15, 2 + 5, 3)
    assert evaluation.speaker_errors([(1, "x", 0, 5)], 5)["der"] is None
    with pytest.raises(ValueError):
        evaluation.speaker_errors([(0, str(i), 0, 1) for i in range(9)], 5)


def test_pack_and_assign():
    assert evaluation.pack([50, 60, 20, 130, 100, 20], 120) == [0, 0, 1, None, 1, 2]
    assert evaluation.assign(4, [("ann", 1, 1.0), ("bo", 0, 2.0), ("cy", 0, 0.0)]) == ["bo", "cy", "bo", "ann"]


def test_canonical_json():
    assert feeds.canonical_json({"b": 1.0, "a": [2.5, None, True, "é\n"], "": 1e21}) == '{"":1e+21,"a":[2.5,null,true,"é\\n"],"b":1}'
