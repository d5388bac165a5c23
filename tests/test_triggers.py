"""Triggers of several parts on worked cases, and the weighted similarity against a plain count."""

import math
import random

import pytest
from pyspark.sql import functions as F

from annoloom.functions import fuzzy
from annoloom.operators import triggers

TOKENS = "doc_id int, u int, tok_idx int, head int, pos string, dep string, first string"


def toks(spark, rows):
    return spark.createDataFrame([(1, 1, *r, "clash") for r in rows], TOKENS)


def test_runs_reach_less_than_the_limit(spark):
    parts = spark.createDataFrame([(1, 1, 0, 0, 0), (1, 1, 1, 4, 4)], "doc_id int, u int, part_no int, first int, last int")
    reached = lambda most: {(r.i, r.j) for r in triggers.runs_of_parts(parts, ["doc_id", "u"], most).collect()}
    assert reached(5) == {(0, 0), (0, 1), (1, 1)} and reached(4) == {(0, 0), (1, 1)} and reached(0) == set()


def test_content_counts_in_parts_only(spark):
    tokens = toks(spark, [(0, 1, "DET", "det"), (1, 2, "VERB", "x"), (2, 3, "VERB", "x"), (3, 4, "VERB", "x"), (4, 4, "NOUN", "x")])
    parts = spark.createDataFrame([(1, 1, 0, 0, 0), (1, 1, 1, 4, 4)], "doc_id int, u int, part_no int, first int, last int")
    best = triggers.best_run(parts, tokens, ["doc_id", "u"], 9).first()
    assert (best.i, best.j, best.value) == (0, 0, 0.0)  # one noun: ln 1 = 0 in every run; the first stands
    wide = spark.createDataFrame([(1, 1, 0, 0, 1), (1, 1, 1, 3, 4)], "doc_id int, u int, part_no int, first int, last int")
    best = triggers.best_run(wide, tokens, ["doc_id", "u"], 9).first()
    assert (best.i, best.j) == (0, 1) and best.value == pytest.approx(math.log(3) / (1 + math.log(5)))  # two verbs and a noun in five tokens


@pytest.mark.parametrize("distance, want", [(1, (3, 4)), (2, (3, 8)), (3, (-2, 8)), (None, (-9, 8)), (0, (-9, 8))])
def test_distance_is_what_lies_between(spark, distance, want):
    """Core 3-4; parts two tokens after, three before and far before it."""
    df = spark.createDataFrame([(3, 4, [(7, 8), (-2, -1), (-9, -8)]), (3, 4, None)], f"a int, b int, parts {triggers.PARTS}")
    got = [tuple(r.x) for r in df.select(triggers.filled_span(F.col("a"), F.col("b"), F.col("parts"), distance).alias("x")).collect()]
    assert got == [want, (3, 4)]


def test_heads(spark):
    rows = [(4, 6, "DET", "det"), (5, 6, "NOUN", "nsubj"), (6, 2, "VERB", "ROOT"), (7, 6, "NOUN", "obj")]
    pick = lambda df, **kw: triggers.head_token(df, ["u"], **kw).first().tok_idx
    assert pick(toks(spark, rows)) == 6 and pick(toks(spark, rows), noun=True) == 5
    assert pick(toks(spark, [(4, 4, "NOUN", "x"), (5, 4, "NOUN", "x")]), noun=True) == 4
    assert pick(toks(spark, [(4, 9, "VERB", "x"), (5, 9, "NOUN", "x")]), noun=True) == 4  # the noun hangs elsewhere
    assert pick(toks(spark, [(4, 5, "VERB", "x"), (5, 4, "VERB", "x")])) == 4 and pick(toks(spark, [(4, None, "X", None)])) == 4
    assert triggers.head_token(toks(spark, []), ["u"]).count() == 0


@pytest.mark.parametrize("width, want", [(2, (4, 5)), (9, (3, 6))])
def test_truncate(spark, width, want):
    tokens = toks(spark, [(3, 4, "DET", "det"), (4, 5, "NOUN", "nsubj"), (5, 5, "VERB", "ROOT"), (6, 5, "ADP", "prep")])
    assert tuple(triggers.truncate(tokens, ["u"], width).first()) == (1, *want)


def test_root_counts_whatever_its_dependency(spark):
    """The root of a span inside a sentence is seldom its ROOT: its head lies outside the span."""
    tokens = toks(spark, [(3, 9, "ADV", "advmod"), (4, 3, "ADV", "x"), (5, 3, "ADV", "x"), (6, 3, "ADJ", "x")])
    assert tuple(triggers.truncate(tokens, ["u"], 1).first()) == (1, 3, 3)  # root 1.0 and ADJ 1.0 are equal: the first
    assert tuple(triggers.truncate(tokens.withColumn("dep", F.when(F.col("tok_idx") == 6, "amod")), ["u"], 1).first()) == (1, 6, 6)


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_letters_against_a_table():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randrange(90))) for _ in "xy")
        assert fuzzy.shared(a, b) == lcs(a, b) == fuzzy.shared(b, a)


def test_weighted_similarity(spark):
    cases = {("new york mets", "new YORK mets!"): 100, ("new york mets", "the wonderful new york mets"): 90, ("new york mets vs atlanta braves", "atlanta braves vs new york mets"): 95, ("", "x"): 0, ("...", "!"): 0, ("growth", "grwth"): 91, ("profit", "profits"): 92}
    df = spark.createDataFrame([*cases, (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(fuzzy.weighted_ratio(F.col("a"), F.col("b"))).collect()] == [*cases.values(), 0]
    assert all(fuzzy.weighted(a, b) == fuzzy.weighted(b, a) for a, b in cases)
