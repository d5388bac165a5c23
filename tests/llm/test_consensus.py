"""Consensus on planted labels, spellings of types, ties and empty tables."""

import random

from annoloom.llm.consensus import consensus, latest, main_types, reliabilities

CODERS = ["a", "b", "c"]
ITEMS = "item long, a string, b string, c string, label string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], ITEMS)


def test_reliabilities_follow_the_planted_accuracies(spark):
    rng = random.Random(8)
    share = {"a": 0.9, "b": 0.6, "c": 0.75}
    rows = []
    for i in range(1500):
        truth = rng.choice("pqrs")
        rows.append((i, *(None if rng.random() < 0.2 else truth if rng.random() < share[k] else rng.choice("pqrs") for k in CODERS)))
    df = frame(spark, rows)
    scores = {r.annotator: r.reliability for r in reliabilities(df, CODERS).collect()}
    assert sorted(scores, key=scores.get) == ["b", "c", "a"]
    out = {r.item: r for r in consensus(df, "item", CODERS, reliabilities(df, CODERS)).collect()}
    for i, *labels in rows:
        given = [x for x in labels if x]
        if len(given) < 2:
            assert i not in out
            continue
        top = max(map(given.count, given))
        leaders = {x for x in given if given.count(x) == top}
        want = leaders.pop() if len(leaders) == 1 else next(x for x in (labels[0], labels[2], labels[1]) if x)
        assert out[i].label == want


def test_no_votes(spark):
    for rows in ([], [(1, None, None, None)], [(1, "x", None, None)]):
        df = frame(spark, rows)
        scores = reliabilities(df, CODERS)
        assert all(r.reliability == 0 for r in scores.collect())
        assert consensus(df, "item", CODERS, scores).count() == 0


def test_spellings(spark):
    typology = spark.createDataFrame([("Goods/Offer", "Goods/Offer"), ("Goods/Offer.Recall", "Goods/Offer"), ("Funding", "Funding"), (None, None)], "full_name string, maintype_name string")
    cells = {"Goods / Offer": "Goods/Offer", "goods_offer": "Goods/Offer", "GoodsOffer": "Goods/Offer", "Goods/Offer.Recal": "Goods/Offer", " FUNDING": "Funding", "Fundng": "Funding", "Fun": None, "Missing": None, "-": None, "": None, None: None, "x" * 100_000: None}
    df = spark.createDataFrame(list(enumerate(cells)), "i int, c string")
    assert {r.i: r.c for r in main_types(df, ["c"], typology).collect()} == dict(enumerate(cells.values()))
    assert main_types(df, ["c"], typology.limit(0)).filter("c is not null").count() == 0


def test_latest(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 6, None), (2, 5, "a"), (2, 5, "b"), (3, None, "z")], "i int, t int, c string")
    assert {r.i: r.c for r in latest(df, "i", "t", ["c"]).collect()} == {1: None, 2: "b", 3: "z"}
