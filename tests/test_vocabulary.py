"""Vocabulary hits, replacements, word places, sound codes and pairs: literal cases and brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from turnwise.functions import phonetics, vocabulary as v

WORDS = "array<struct<word:string,start:double,end:double>>"


def vocab(spark, *terms):
    return v.vocabulary(spark.createDataFrame([(t,) for t in terms], "term string"))


def said(spark, *turns):
    """One unit whose words are split at spaces, a second each."""
    rows, at = [], 0
    for i, text in enumerate(turns):
        ws = text.split()
        rows.append(("u", i, text, [(w, float(at + k), float(at + k + 1)) for k, w in enumerate(ws)]))
        at += len(ws)
    return spark.createDataFrame(rows, f"unit string, turn int, text string, words {WORDS}")


def merged(spark, turns, terms):
    df = v.merge_terms(said(spark, *turns), vocab(spark, *terms), "unit", "turn")
    return {r.turn: r for r in df.collect()}


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("Wi-Fi at Café O’Neill's", ["wi", "fi", "at", "cafe", "oneills"]), ("(noise) ok, R&D f~ done_now", ["okay", "r", "and", "d", "done", "now"]), ("...", []), ("", [])],
)
def test_tokens(spark, text, tokens):
    assert spark.createDataFrame([(text,)], "t string").select(v.spoken_tokens(F.col("t"))).first()[0] == tokens


@pytest.mark.parametrize(
    ("term", "problem", "key"),
    [("Wi-Fi", None, "wifi"), ("Ünder Ärmel", None, "underarmel"), (" x y", "not_normalized", "xy"), ("", "empty", ""), ("a" * 61, "too_long", "a" * 61), ("a b c d e f", "too_many_words", "abcdef"), ("Route 66", "digit", "route"), ("a+b", "character", "ab"), ("-ab", "must_start_with_letter", "ab"), ("x.", "too_few_letters", "x")],
)
def test_terms(spark, term, problem, key):
    got = spark.createDataFrame([(term,)], "t string").select(v.term_problem(F.col("t")), v.term_key(F.col("t"))).first()
    assert tuple(got) == (problem, key)


def test_words_are_found_after_the_one_before(spark):
    row = spark.createDataFrame([("the cat, the hat", ["the", " hat ", "cat", "", "the"])], "t string, w array<string>")
    assert row.select(v.locate_words(F.col("t"), F.col("w"))).first()[0] == [(0, 3), (13, 16), None, None, None]


def test_scan_takes_the_earlier_and_then_the_longer(spark):
    df = said(spark, "new york city hall", "in new", "york")
    hits = v.term_hits(df.withColumn("tokens", v.spoken_tokens(F.col("text"))), vocab(spark, "New York", "New York City", "York", "City Hall", "Newyorkcity Xy"), "unit", "turn").collect()
    assert sorted((r.turn, r.first, r["size"], r.term) for r in hits) == [(0, 0, 3, "New York City"), (1, 1, 2, "New York")]


def brute_hits(tokens, terms):
    keyed = sorted(((("".join(t)), len(t), name) for name, t in terms), key=lambda x: (-len(x[0]), x[2]))
    out, i = [], 0
    while i < len(tokens):
        best = next(((k, name) for key, n, name in keyed for k in range(1, n + 2) if i + k <= len(tokens) and "".join(tokens[i : i + k]) == key), None)
        if best:
            out.append((i, *best))
            i += best[0]
        else:
            i += 1
    return out


def test_scan_against_brute_force(spark):
    rng = random.Random(3)
    units = [(u, t, [rng.choice(["a", "b", "ab", "ba", "aa"]) for _ in range(rng.randint(0, 9))]) for u in range(30) for t in range(4)]
    names = ["ab", "a b a", "aab", "b a", "bb", "abab"]
    got = v.term_hits(spark.createDataFrame(units, "unit int, turn int, tokens array<string>"), vocab(spark, *names), "unit", "turn").collect()
    for u in range(30):
        flat, where = [], []
        for _, t, ts in (x for x in units if x[0] == u):
            flat += ts
            where += [(t, i) for i in range(len(ts))]
        want = [(*where[i], k, name) for i, k, name in brute_hits(flat, [(n, n.split()) for n in names])]
        assert sorted((r.turn, r.first, r["size"], r.term) for r in got if r.unit == u) == sorted(want)


def test_replacements_keep_marks_and_share_time(spark):
    got = merged(spark, ["we met at (silver brook), then (silverbrook)", "no terms here"], ["Silverbrook", "Amber Harbor"])
    assert got[0].text == "we met at (Silverbrook), then (silverbrook)"  # a word in brackets is a mark and no speech
    got = merged(spark, ["we met at silver brook, then amberharbor!", "silver-brook silverbrook"], ["Silverbrook", "Amber Harbor"])
    assert got[0].text == "we met at Silverbrook, then Amber Harbor!"
    assert [(w.word, w.start, w.end) for w in got[0].words] == [("we", 0, 1), ("met", 1, 2), ("at", 2, 3), ("Silverbrook,", 3, 5), ("then", 5, 6), ("Amber", 6, 6.5), ("Harbor!", 6.5, 7)]
    hits = [h for h in got[0].hits if h.status == "accepted"]
    assert [(h.term, h.heard, got[0].text[h.char_begin : h.char_end], h.word_begin, h.word_end, h.start, h.end) for h in hits] == [("Silverbrook", "silver brook,", "Silverbrook", 3, 4, 3, 5), ("Amber Harbor", "amberharbor!", "Amber Harbor", 5, 7, 6, 7)]
    assert got[1].text == "Silverbrook silverbrook"
    assert [h.status for h in got[1].hits] == ["accepted", "already_correct"]


def test_reasons(spark):
    got = merged(spark, ["over at silver", "brook today"], ["Silverbrook"])
    assert [h.status for h in got[0].hits] == ["crosses_turn"] and got[0].text == "over at silver"
    rows = [("u", 0, "silver / brook", [("silver", 0.0, 1.0), ("brook", 1.0, 2.0)]), ("w", 0, "silber brook", [("silver", 0.0, 1.0), ("brook", 1.0, 2.0)])]
    lost = v.merge_terms(spark.createDataFrame(rows, f"unit string, turn int, text string, words {WORDS}"), vocab(spark, "Silverbrook"), "unit", "turn").collect()
    assert [[h.status for h in r.hits] for r in lost] == [["unlocated"], ["unlocated"]]
    got = merged(spark, ["silver brook-amber harbor"], ["Silverbrook", "Amberharbor"])
    assert [(h.term, h.status) for h in got[0].hits] == [("Silverbrook", "accepted"), ("Amberharbor", "overlap")]
    assert got[0].text == "Silverbrook harbor"
    got = merged(spark, ["onetwothree"], ["One two three"])
    assert [h.status for h in got[0].hits] == ["rule"]
    none = v.merge_terms(said(spark, "", "x"), vocab(spark, "Silverbrook"), "unit", "turn").collect()
    assert [(r.text, r.hits) for r in none] == [("", []), ("x", [])]


def test_sound_codes():
    # Codes of the published algorithm.
    known = "smith SM0 XMT, schmidt XMT SMT, thompson TMPSN TMPSN, school SKL SKL, schenker XNKR SKNKR, caesar SSR SSR, chianti KNT KNT, michael MKL MXL, character KRKTR KRKTR, architect ARKTKT ARKTKT, bacher PKR PKR, accident AKSTNT AKSTNT, bacchus PKS PKS, focaccia FKX FKX, edge AJ AJ, edgar ATKR ATKR, laugh LF LF, tagliaro TKLR TLR, jose HS HS, cabrillo KPRL KPR, dumb TM TM, campbell KMPL KMPL, rogier RJ RJR, island ALNT ALNT, sugar XKR SKR, nation NXN NXN, thomas TMS TMS, filipowicz FLPTS FLPFX, breaux PR PR, zhao J J, wachtler AKTLR FKTLR, hugh H H, ghislane JLN JLN, resnais RSN RSNS, czerny SRN XRN, mchugh MK MK, succeed SKST SKST, pizza PS PTS, danger TNJR TNKR, biaggi PJ PK, arnow ARN ARNF, science SNS SNS"
    for item in known.split(", "):
        word, first, second = item.split()
        assert (word, *phonetics.double_metaphone(word)) == (word, first, second)
    assert phonetics.word_codes("hh") == ("H", "H") and phonetics.word_codes("") == ("", "")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def close(a, b):
    return 1 - distance(a, b) / max(len(a), len(b)) if a or b else 1.0


def test_accepted_pairs_against_all_pairs(spark):
    rng = random.Random(9)
    syllables = ["sil", "ver", "gan", "brad", "ston", "knee", "phil", "wric", "th", "sch", "mit", "qua", "xen", "bough"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    terms = [(f"t{i}", [word() for _ in range(rng.randint(1, 3))]) for i in range(60)]
    heard = [(f"h{i}", [word() for _ in range(rng.randint(1, 3))]) for i in range(150)]
    heard += [(f"c{i}", [*ts[:-1], ts[-1][:-1] + "x"]) for i, (_, ts) in enumerate(terms)] + [(f"s{i}", ts) for i, (_, ts) in enumerate(terms)]
    frames = [spark.createDataFrame(rows, f"{name} string, tokens array<string>") for rows, name in ((terms, "term"), (heard, "heard"))]
    got = {(r.term, r.heard): (r.phonetic, r.character) for r in phonetics.accepted_pairs(*frames).collect()}
    want = {}
    for t, a in terms:
        for h, b in heard:
            codes = [[phonetics.word_codes(w) for w in side] for side in (a, b)]
            sound = max(close("".join(c[i] for c in codes[0]), "".join(c[j] for c in codes[1])) for i in (0, 1) for j in (0, 1))
            chars = close("".join(a), "".join(b))
            if sound >= 0.70 and chars >= 0.60 and abs(len(a) - len(b)) <= 1 and a != b:
                want[t, h] = (sound, chars)
    assert got.keys() == want.keys() and len(want) > 40
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_relevance_and_glossary_against_brute_force(spark):
    rng = random.Random(4)
    syllables = ["am", "ber", "har", "bor", "phone", "fone", "key", "quay", "ice", "sky"]
    names = ["Amber Harbor", "Phone Key", "Skyamber", "Ice Quay Har", "Zebra Xylo"]
    units = [(u, t, ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, 6))]) for u in range(6) for t in range(3)]
    vocab_df = vocab(spark, *names)
    df = spark.createDataFrame(units, "unit int, turn int, tokens array<string>")
    ranked = phonetics.term_relevance(df, vocab_df, "unit", "turn")
    got = {(r.unit, r.term): (r.score, r["rank"]) for r in ranked.collect()}

    def heads(ts):
        return {"c" + ts[0][0], *("p" + c[:1] for c in phonetics.word_codes(ts[0]))}

    want = {}
    for u in range(6):
        flat = [w for x in units if x[0] == u for w in x[2]]
        for name in names:
            own = name.lower().split()
            codes = [phonetics.word_codes(w) for w in own]
            best = 0
            for n in {max(1, len(own) - 1), len(own), len(own) + 1}:
                for i in range(len(flat) - n + 1):
                    run = flat[i : i + n]
                    c = close("".join(run), "".join(own))
                    if c >= 0.4 - 1e-12 and heads(run) & heads(own):
                        other = [phonetics.word_codes(w) for w in run]
                        best = max(best, 0.5 * c + 0.5 * max(close("".join(x[k] for x in codes), "".join(x[m] for x in other)) for k in (0, 1) for m in (0, 1)))
            if best:
                want[u, name] = best
    assert got.keys() == want.keys() and len(want) >= 8
    assert all(got[k][0] == pytest.approx(want[k]) for k in want)
    packed = {r.unit: r for r in phonetics.glossary(ranked, "unit", 12).collect()}
    assert packed.keys() == {k[0] for k in want}
    for u in packed:
        order = sorted((k[1] for k in want if k[0] == u), key=lambda t: got[u, t][1])
        chosen = []
        for t in order:
            text = " Glossary: " + ", ".join([*chosen, t]) + "."
            if max(int(len(text.split(" ")) * 1.3) + 1, (len(text) + 2) // 3) <= 12:
                chosen.append(t)
        assert packed[u].glossary == "Glossary: " + ", ".join(chosen) + "." and packed[u].chosen == len(chosen)
