"""Rubric checks on phrases: the best fuzzy window of a call's words, and the verdicts made of it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnwise.registry import register
from turnwise.sources.tables import turns

#: Confidences of verdicts without a match, of a conditional check without a trigger, and the most that a match gives.
ABSENT, NOT_ASKED, MOST = 0.95, 0.90, 0.99
#: Turns after the trigger's within which the response has to fall.
RESPONSE_TURNS = 2


@lru_cache(maxsize=100_000)
def _at_most(target: str, window: str) -> float:
    """The matcher's quick_ratio: the share of letters that both have."""
    return 2.0 * (Counter(target) & Counter(window)).total() / (len(target) + len(window))


@lru_cache(maxsize=100_000)
def _likeness(target: str, window: str) -> float:
    return SequenceMatcher(None, target, window).ratio()


def best_window(words: list[str], phrase: str, threshold: int) -> tuple[float, int, int] | None:
    """(score, first word, end) of the window most like the phrase, of its number of words or one more or less; the first of equals.

    Windows that the matcher's upper bounds rule out, first by length, are not compared; equal ones are compared once.
    """
    target = phrase.lower().strip()
    if not words or not target:
        return None
    low = [w.lower() for w in words]
    n = len(target.split())
    best: tuple[float, int, int] | None = None
    for size in sorted({n, n + 1, max(1, n - 1)}):
        for i in range(max(1, len(low) - size + 1)):
            window = low[i : i + size]
            said = " ".join(window)
            floor = max(threshold, best[0] if best else 0) / 100
            if 2.0 * min(len(target), len(said)) / (len(target) + len(said)) < floor or _at_most(target, said) < floor:
                continue
            score = _likeness(target, said) * 100
            if score >= threshold and (best is None or score > best[0]):
                best = (score, i, i + len(window))
    return best


@dataclass(frozen=True)
class PhraseCheck:
    """One criterion. kind: any, all, none or response; speaker: whose turns are searched."""

    criterion: str
    kind: str
    phrases: tuple[str, ...]
    threshold: int = 85
    speaker: str | None = "AGENT"
    triggers: tuple[str, ...] = ()


def _find(call: list[tuple[int, str, str]], phrases: tuple[str, ...], threshold: int) -> list[tuple[float, str, int, str] | None]:
    """For each phrase (score, quote, turn of its first word, phrase), over the words of all the turns (turn, speaker, text)."""
    words = [(w, t) for t, _, text in call for w in text.split()]
    out = []
    for p in phrases:
        hit = best_window([w for w, _ in words], p, threshold)
        out.append((hit[0], " ".join(w for w, _ in words[hit[1] : hit[2]]), words[hit[1]][1], p) if hit else None)
    return out


def judge(call: list[tuple[int, str, str]], check: PhraseCheck) -> tuple[str, float, str | None, int | None]:
    """(status, confidence, quote, turn) of one check on one call's turns (turn, speaker, text) in order."""
    scope = [t for t in call if check.speaker is None or t[1] == check.speaker]
    if check.kind == "response":
        asked = [h for h in _find([t for t in call if t[1] == "CALLER"], check.triggers, check.threshold) if h]
        if not asked:
            return "PASS", NOT_ASKED, None, None
        at = max(asked, key=lambda h: h[0])[2]
        place = next(i for i, t in enumerate(call) if t[0] == at)
        scope = [t for t in call[place + 1 : place + 1 + RESPONSE_TURNS] if t[1] == check.speaker]
    found = _find(scope, check.phrases, check.threshold)
    hits = [h for h in found if h]
    best = max(hits, key=lambda h: h[0]) if hits else None
    passed = {"any": bool(hits), "response": bool(hits), "all": len(hits) == len(found), "none": not hits}[check.kind]
    shown = best if best and (check.kind == "none" or passed) else None
    return "PASS" if passed else "FAIL", min(MOST, shown[0] / 100) if shown else ABSENT, shown[1] if shown else None, shown[2] if shown else None


def verdicts_of(rows: DataFrame, checks: tuple[PhraseCheck, ...], call_col: str = "conv_id") -> DataFrame:
    """(call, criterion, status, confidence, quote, turn) of every call of rows(call, turn, speaker, text); a call's turns are one row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for i, told in zip(f["call"], f["told"], strict=True):
                call = [(t["turn"], t["speaker"], t["text"]) for t in told]
                found += [(i, c.criterion, *judge(call, c)) for c in checks]
            yield pd.DataFrame(found, columns=["call", "criterion", "status", "confidence", "quote", "turn"]).astype({"turn": "Int64"})

    # One row for each call: groups of a data frame each would cost more than their checks.
    turn = F.struct("turn", "speaker", F.coalesce("text", F.lit("")).alias("text"))
    told = rows.groupBy(F.col(call_col).alias("call")).agg(F.sort_array(F.collect_list(turn)).alias("told"))
    return told.mapInPandas(run, "call bigint, criterion string, status string, confidence double, quote string, turn bigint").withColumnRenamed("call", call_col)


CHECKS = (
    PhraseCheck("opening", "any", ("of the and", "thank you for calling")),
    PhraseCheck("disclosure", "all", ("the", "and of")),
    PhraseCheck("prohibited", "none", ("guaranteed return",)),
)
RESPONSES = (PhraseCheck("retention", "response", ("of the", "happy to help"), triggers=("to the", "cancel my account")),)


@register("str07_phrase_rules")
def str07_phrase_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts_of(turns(spark, sf_dir), CHECKS)


@register("str08_conditional_response")
def str08_conditional_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts_of(turns(spark, sf_dir), RESPONSES)


@register("wn15_phrase_window")
def wn15_phrase_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of each turn for a phrase, at 70 % and more."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(c, t, *hit) for c, t, text in f.itertuples(index=False) if (hit := best_window(text.split(), "and of the", 70))]
            yield pd.DataFrame(found, columns=["conv_id", "turn", "score", "first_word", "end_word"])

    return turns(spark, sf_dir).select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "conv_id bigint, turn bigint, score double, first_word int, end_word int")
