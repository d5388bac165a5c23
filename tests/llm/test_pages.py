"""Pages: planted kinds of spam among sentences, and texts at the edges."""

import random

import numpy as np
import pyarrow as pa

from annoloom.llm.page_words import enumerated, shingles, words_of
from annoloom.llm.pages import FILTER_BITS, pages_without_sentences, phrase_filter, score_pages

DOCS = "doc_id long, text string, title string, ticker string, share_against double"
NOUNS = "market price court factory board lender union plant rival profit".split()


def prose(rng, n=12):
    return " ".join(f"The {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} said that it {rng.choice(['rose', 'fell', 'closed'])} by {rng.randrange(90)} percent in the quarter." for _ in range(n))


def spam(rng, kind):
    keys = rng.sample(["cheap loans", "gold coins sale", "forex robot", "free stock picks", "debt relief", "payday cash"], 3)
    if kind == 0:
        return " | ".join(rng.choice(keys) for _ in range(60))
    if kind == 1:
        return "\n".join(f"https://www.site{rng.randrange(50)}.example/{rng.choice(NOUNS)}/{rng.choice(NOUNS)}.html" for _ in range(40))
    if kind == 2:
        return " ".join(f"#{rng.choice(NOUNS)}{rng.randrange(99)}" for _ in range(50))
    if kind == 3:
        return "\n".join(f'<a href="https://a.example/{rng.randrange(99)}">{rng.choice(NOUNS)} {rng.choice(NOUNS)}</a>' for _ in range(40))
    words = prose(rng, 3).split()
    return " ".join(f"{w} {rng.choice(keys)}" for w in words)


def test_planted_pages(spark):
    rng = random.Random(5)
    rows, bad = [], set()
    for i in range(400):
        kind = i % 8
        text = spam(rng, kind) if kind < 5 else prose(rng)
        if kind == 7:
            text += "\n" + " | ".join(["cheap loans", "debt relief"] * 4)
        if kind < 5:
            bad.add(i)
        rows.append((i, text, f"t{i % 50:02}_x.txt" if i % 3 else None, f"h{i % 40}" if i % 2 else None, 0.0))
    copy = (1000, rows[0][1], None, None, 0.0)
    df = spark.createDataFrame([*rows, copy], DOCS)
    assert {r.doc_id for r in pages_without_sentences(df).collect()} == bad | {1000}


def test_edges(spark):
    rows = [(1, None, None, None, 0.0), (2, "", "x", "y", 0.0), (3, " \n\t", "", "", 0.0), (4, "%% 12 !!", None, None, 0.0), (5, "word " * 400_000, None, None, 0.0), (6, prose(random.Random(1)), None, None, 0.0)]
    out = {r.doc_id: r for r in score_pages(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(out) == {4, 5, 6}
    assert out[4].share_against == 1.0 and out[4].n_words == 0 and out[5].share_against == 1.0 and out[6].share_against < 0.2
    assert score_pages(spark.createDataFrame([], DOCS)).count() == 0


def test_sentences_of_several_languages():
    for text in ("Der Gewinn stieg um 5 Prozent, teilte das Unternehmen mit.", "De bank verlengt het krediet van 5 miljoen tot 2024.", "Le conseil proposera un dividende inchangé à l'assemblée.", "La demanda en la costa fue más débil de lo previsto.", "同社は314人の雇用を予定している。"):
        words = words_of(pa.array([text]))
        assert len(words.page) and not words.link.any() and not words.listed.any(), text


def test_links_tags_and_lists():
    for text in ("see https://a.example/b?c=1", "www.a.example", "hxxp://a[.]test", "a dot test", "tape.invalid/x", "#hedge25", "$ABCX", "[a label](b.test/c)", '<a href="x">a label</a>', "Breakout-Court SwingRate"):
        words = words_of(pa.array([text]))
        assert words.link[1:].all() and words.link[0] == (text[:3] != "see"), text
    assert words_of(pa.array(["red mug | blue mug, desk lamp (12)\nHome"])).listed.all()
    assert not words_of(pa.array(["we paid 1,234,567 more for it than anyone had asked us to", "It rose, fell, rose."])).listed.any()


def test_equal_words_have_equal_codes_wherever_they_stand():
    a, b = words_of(pa.array(["x Gains y", "", None, "zz gains ümlaut"])), words_of(pa.array(["gains"]))
    assert a.page.tolist() == [0, 0, 0, 3, 3, 3] and a.place.tolist() == [0, 1, 2, 0, 1, 2]
    assert a.code[1] == a.code[4] == b.code[0] and len(set(a.code.tolist())) == 5
    assert words_of(pa.array(["即日融資なら無料"])).place.tolist() == [0, 1, 2]


def test_enumerated_phrases_against_plain_counts():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60))) + "." for _ in range(50)]
    words = words_of(pa.array(texts))
    code, at = shingles(words, 2)
    got = enumerated(words, code, at, 2)
    tokens = [t.rstrip(".").split() for t in texts]
    for k, i in enumerate(at):
        own, j = tokens[words.page[i]], int(words.place[i])
        places = [p for p in range(len(own) - 1) if own[p : p + 2] == own[j : j + 2]]
        left, right = {own[p - 1] if p else None for p in places}, {own[p + 2] if p + 2 < len(own) else None for p in places}
        assert got[k] == (len(places) >= 3 and len(left) >= 3 and len(right) >= 3 and 2 * len(places) >= 0.05 * len(own))


def test_both_evidences_are_needed(spark):
    """Keywords put between the words of sentences fall to the hosts that list them, lists of names that stand nowhere else to their density."""
    rng = random.Random(7)
    rows, mixed, unique = [], set(), set()
    for i in range(300):
        if i % 5 == 0:
            text = spam(rng, 0)
        elif i % 5 == 1:
            text = spam(rng, 4)
            mixed.add(i)
        elif i % 5 == 2:
            text = " · ".join(f"w{rng.random()} q{rng.random()}" for _ in range(30)).replace("0.", "x")
            unique.add(i)
        else:
            text = prose(rng)
        rows.append((i, text, None, f"h{i % 40}", 0.0))
    df = spark.createDataFrame(rows, DOCS)
    found = lambda **kw: {r.doc_id for r in score_pages(df, **kw).filter("share_against > 0.5").collect()}
    both = found()
    assert mixed | unique <= both and not any(i % 5 > 2 for i in both)
    assert not found(least_hosts=1 << 40) & mixed and unique <= found(least_hosts=1 << 40)
    assert not found(longest_item=0.0) & unique


def test_filter_holds_every_candidate(spark):
    from annoloom.llm.pages import _probes

    codes = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000, np.int64)
    bitmap, bits = phrase_filter(spark.createDataFrame([(int(c),) for c in codes], "phrase long"))
    hit = lambda c: np.all((bitmap[_probes(c, bits) >> 3] >> (_probes(c, bits) & 7).astype(np.uint8)) & 1, axis=0)
    assert hit(codes).all() and bits <= FILTER_BITS
    assert hit(codes ^ 0x5555555555).mean() < 0.05
    assert phrase_filter(spark.createDataFrame([], "phrase long"))[0].sum() == 0
