"""Quotes against plain dynamic programming, and the rule's own cases."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papershed.operators import quotes as Q


def bare(text):
    return re.sub(r"\s+", "", text)


def plain_search(text, pattern, most):
    """Least edits and all (start, end) with them, starts as early as they can be: the full table."""
    rows = [[(0, at) for at in range(len(text) + 1)]]  # (edits, start), the least start of the least edits
    for k, c in enumerate(pattern, 1):
        row = [(k, 0)]
        for at in range(1, len(text) + 1):
            options = [(rows[-1][at - 1][0] + (c != text[at - 1]), rows[-1][at - 1][1]), (rows[-1][at][0] + 1, rows[-1][at][1]), (row[-1][0] + 1, row[-1][1])]
            row.append(min(options))
        rows.append(row)
    found = [(edits, start, at) for at, (edits, start) in enumerate(rows[-1]) if at]
    least = min((f[0] for f in found), default=most + 1)
    return [(s, e, d) for d, s, e in found if d == least <= most]


def plain_place(text, quote, prefix, suffix, position):
    most = min(256, len(quote) // 8)
    if most < 1 or not text:
        return None
    agree = lambda actual, expected: None if not expected else 1 - min([len(expected)] + [d for _, _, d in plain_search(actual, expected, len(expected))]) / len(expected) if actual else 0
    scored = []
    for s, e, d in plain_search(text, quote, most):
        a, z = agree(text[max(0, s - len(prefix)) : s], prefix), agree(text[e : e + len(suffix)], suffix)
        if len(quote) < 32 and not ((a or 0) >= 0.5 or (z or 0) >= 0.5):
            continue
        near = 1 if position is None else 1 - abs(s - position) / len(text)
        scored.append((50 * (1 - d / len(quote)) + 20 * (1 if a is None else a) + 20 * (1 if z is None else z) + 2 * near, s, e, d))
    scored.sort(key=lambda x: -x[0])
    if not scored:
        return None
    best = scored[0]
    rival = next((x for x in scored if x is not best and (x[2] <= best[1] or x[1] >= best[2])), None)
    return None if rival and best[0] - rival[0] < 1e-9 else Q.Place(*best[1:])


WORDS = ["the", "cache", "keeps", "every", "response", "for", "an", "hour", "a", "day"]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_places_equal_the_full_table(seed):
    draw = random.Random(seed)
    text = "".join(draw.choice(WORDS) for _ in range(draw.randint(3, 30)))
    at, length = draw.randint(0, len(text)), draw.randint(8, 60)
    quote = list(text[at : at + length])
    for _ in range(draw.randint(0, len(quote) // 8)):
        k = draw.randint(0, max(0, len(quote) - 1))
        quote[k : k + draw.randint(0, 1)] = draw.choice(["", "x", "e", "th"])
    quote, text = "".join(quote), draw.choice([text, text * 2, text[: len(text) // 2]])
    context = draw.choice(["", "hourcache", text[max(0, at - 8) : at]]), draw.choice(["", "zzz", text[at + length : at + length + 8]])
    position = draw.choice([None, at, 0])
    assert Q.approximate_place(text, quote, *context, position) == plain_place(text, quote, *context, position)


def test_cases_of_the_rule():
    quote = bare("The cache keeps every response for an hour before it asks again.")
    text = bare("Intro text. The cache keeps every response for a day before it asks again. Outro text.")
    place = Q.approximate_place(text, quote, bare("Intro text."), bare("Outro text."))
    assert text[place.start : place.end] == bare("The cache keeps every response for a day before it asks again.")
    assert Q.approximate_place(bare("Another article about gardening, soil and the slow work of compost."), quote) is None
    assert Q.approximate_place(bare("Before. unconditional replies for page invalidations. After."), bare("conditional requests for cache validation"), "Before.", "After.") is None
    assert Q.approximate_place("theprotocolusesconditional", "protocl", "the", "uses") is None
    short, before, after = bare("See Section 3.2"), bare("as described below."), bare("for details on caching")
    assert Q.approximate_place(bare("Unrelated lead-in. See Section 3.1 for the rest."), short, before, after) is None
    text = bare("as described below. See Section 3.4 for details on caching")
    place = Q.approximate_place(text, short, before, after)
    assert text[place.start : place.end] == bare("See Section 3.4")
    quote = bare("the request is retried after a short backoff")
    text = bare("Reads: the request is retried after a shorter backoff, then fails. Writes: the request is retried after a shorter backoff, then succeeds.")
    assert Q.approximate_place(text, quote, "Writes:", ",thensucceeds.").start == text.rindex(bare("the request is retried"))
    text = bare("A: the request is retried after a shorter backoff. B: the request is retried after a shorter backoff.")
    assert Q.approximate_place(text, quote) is None
    assert Q.approximate_place(text, quote, position=text.rindex("therequest")).start == text.rindex("therequest")


def test_long_quotes_in_long_texts_end_soon():
    import time

    sentence = lambda k: f"Paragraph{k}talksabouttopic{k * 7919 % 1000}atsomelength."
    text, original = "".join(map(sentence, range(2500))), "".join(map(sentence, range(1200, 1240)))
    began = time.perf_counter()
    place = Q.approximate_place(text, original.replace("topic", "subjct"))
    assert (place.start, place.end) == (text.index(original), text.index(original) + len(original)) and time.perf_counter() - began < 10


def test_pieces_that_are_there_by_chance_cost_no_search(monkeypatch):
    draw = random.Random(5)
    letters = lambda n: "".join(draw.choice("etaoinshrdlu") for _ in range(n))
    quote, searched, own = letters(240), [], Q._ends
    text = "".join(letters(400) + piece for _, piece in Q._pieces(quote))
    monkeypatch.setattr(Q, "_ends", lambda *a: searched.append(len(a[0])) or own(*a))
    assert Q.approximate_place(text, quote) is None and sum(searched) < len(text) // 10
    edited = "".join("~" if k % 8 == 7 else c for k, c in enumerate(quote[:232])) + quote[232:]  # 29 of 30 edits
    assert Q.approximate_place(text + edited + text, quote) == Q.Place(len(text), len(text) + 240, 29)
    runs = set(Q._runs(quote))
    for most in (1, 7, 30):
        for _ in range(200):
            other, at = list(quote), draw.sample(range(240), most)
            for k in at:
                other[k] = draw.choice(["", "~", other[k] + "~"])
            part = text[:300] * draw.randint(0, 1) + "".join(other) + text[:300] * draw.randint(0, 1)
            assert Q._may_hold(part, quote, runs, most)
            hits = Q._starts(part, ((at + len(p), f) for p, f in Q._followed(quote) for at in Q._places(part, p)))
            assert any(a <= part.find("".join(other)) and part.find("".join(other)) + len("".join(other)) <= z for a, z in Q._stretches(part, quote, hits))


def test_exact_places():
    text = "aXbaXbaXc"
    assert Q.exact_place(text, "aX", 1, "", "").start == 3
    assert Q.exact_place(text, "aX", 7, "b", "c").start == 6
    assert Q.exact_place(text, "aX", 7, "b", "") is None and Q.exact_place(text, "nowhere", 0, "", "") is None
    assert Q.exact_place(text, "aX", 9, "bbb", "b") is None


NOTES = "quote_id long, text_id long, quote string, occurrence int, position int, prefix string, suffix string"


def test_placed_quotes_of_one_text_and_of_none(spark):
    text = "First things first. The cache keeps every response for a day before it asks again. Then it rests, as caches do."
    notes = [(k, 1, "Thecachekeepseveryresponseforanhourbeforeitasksagain.", 0, 16, "", "") for k in range(1200)]
    notes += [(5000, 1, "Firstthings", 0, 0, "", ""), (5001, 1, "nothingofthekindishere", 0, 0, "a", "b"), (5002, 2, "Firstthings", 0, None, None, None), (5003, 3, "x", 0, 0, "", "")]
    texts = spark.createDataFrame([(1, text, 1), (3, None, 1)], "text_id long, text string, quote int")
    got = {r["quote_id"]: r for r in Q.placed(spark.createDataFrame(notes, NOTES), texts).collect()}
    assert len(got) == len(notes) and {(r["match"], r["start"]) for k, r in got.items() if k < 1200} == {("approximate", 17)}
    assert (got[5000]["match"], got[5000]["start"], got[5000]["end"]) == ("exact", 0, 11)
    assert {got[k]["match"] for k in (5001, 5002, 5003)} == {None}
    assert Q.placed(spark.createDataFrame([], NOTES), texts).count() == 0


@pytest.mark.parametrize("most_blocks, chars", [(4, 1_000_000), (4, 60), (1, 60)])
def test_quotes_of_any_length_in_any_text(spark, monkeypatch, most_blocks, chars):
    monkeypatch.setattr(Q, "BLOCK_CHARS", chars)
    monkeypatch.setattr(Q, "MOST_BLOCKS", most_blocks)
    texts = [(1, "a b c a b c, a long passage that goes on and on"), (2, "abc"), (3, None), (4, "ALONG passage thatgoes on and on, and on and on"), (5, "")]
    quotes = [(1, "abc"), (2, "a long passage that goes on and on"), (3, "b"), (4, " \n"), (5, None), (6, "andon"), (7, "b"), (8, "zz" * 40), (9, "long passage that goes on")]
    got = {tuple(r) for r in Q.anchors(spark.createDataFrame(quotes, "quote_id long, text string"), spark.createDataFrame(texts, "text_id long, text string")).collect()}
    expect = {(q, t, bare(x).index(bare(y)), bare(x).count(bare(y))) for q, y in quotes for t, x in texts if x and y and bare(y) and bare(y) in bare(x)}
    assert got == expect


def test_misquotes_in_any_text_equal_the_full_table(spark, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK_CHARS", 300)
    draw = random.Random(11)
    texts = [(k, " ".join(draw.choice(WORDS) for _ in range(60))) for k in range(40)] + [(99, None)]
    quotes = []
    for k in range(20):
        quote = list(bare(texts[k][1])[20 : 20 + draw.randint(8, 90)])
        for _ in range(len(quote) // 10):
            quote[draw.randint(0, len(quote) - 1)] = draw.choice("xq")
        quotes.append((k, "".join(quote), draw.choice(["", bare(texts[k][1])[:20]])))
    quotes.append((77, "short", ""))
    frame = spark.createDataFrame(quotes, "quote_id long, text string, prefix string")
    got = {tuple(r) for r in Q.approximate_anchors(frame, spark.createDataFrame(texts, "text_id long, text string")).collect()}
    expect = set()
    for q, quote, prefix in quotes:
        for t, text in texts:
            place = plain_place(bare(text or ""), quote, prefix, "", None)
            if place:
                expect.add((q, t, place.start, place.end, place.edits))
    assert got == expect and len(got) > 5


def test_captured_quotes_come_back_where_they_were(spark):
    text = "One two one two. One two three, one two four and  so on to the end of the line, where it stops at last."
    rows = [(k, 1, text, k, 12) for k in range(0, len(text) - 12, 5)]
    selections = spark.createDataFrame(rows, "quote_id long, text_id long, text string, start int, length int")
    notes = Q.captures(selections)
    got = {r["quote_id"]: r for r in Q.placed(notes, selections.select("text_id", "text").distinct()).collect()}
    assert all(got[k]["match"] == "exact" and got[k]["start"] == len(bare(text[:k])) for k, *_ in rows)
