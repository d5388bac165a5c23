"""Groups against union-find, splits against their promises."""

import random

import pytest

from annoloom.llm.groups import mention_groups
from annoloom.operators.graph import star_components
from annoloom.llm.splits import allocate, annotator_number, assign_splits, document_key, min_cost_flow


def union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("pairs", [
    [(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 90)], [(90, i) for i in range(90)], [(random.Random(4).randrange(80), x % 80) for x in range(60)],
    [(1, 1), (2, None), (None, None), (3, 4), (4, 3), (3, 4)], [],
])
def test_components(spark, pairs):
    df = spark.createDataFrame([(a, b, 7) for a, b in pairs], "a long, b long, hi long")
    want = union_find([(a, b) for a, b in pairs if a is not None and b is not None and a != b])
    assert {r.node: r["group"] for r in star_components(df, "a", "b").collect()} == want


def test_mentions(spark):
    df = spark.createDataFrame([(1, 5, 3, 0), (1, 3, 9, 0), (1, 3, 9, 0), (2, 5, 9, 0), (2, 0, 4, 0), (2, None, None, 0), (3, 6, 6, 0), (3, 7, None, 0)], "doc_uid long, pronom_id long, referent_id long, group_id long")
    assert sorted(map(tuple, mention_groups(df).collect())) == [(1, 3, 3), (1, 5, 3), (1, 9, 3), (2, 4, 4), (2, 5, 5), (2, 9, 5), (3, 6, 6), (3, 7, 7)]


@pytest.mark.parametrize("title, key", [
    ("abcd01_x.txt", "abcd01"), (" .\\ABCD01_X-Y.TXT", "abcd01"), ("corpus/batch-b/abcd01_x", "abcd01"), ("Abcd01_x", "abcd01"), ("document_copy.txt", None), ("untitled.txt", None), ("01_x", None), ("", None), (None, None),
])
def test_document_key(spark, title, key):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(document_key(df.t).alias("k")).first().k == key


@pytest.mark.parametrize("name, number", [("anno_0117", 117), (" ANNO-7 ", 7), ("annotation/anno_0267.xmi", 267), ("batch2/Anno9 ", 9), ("admin", None), ("", None), (None, None)])
def test_annotator_number(spark, name, number):
    df = spark.createDataFrame([(name,)], "t string")
    assert df.select(annotator_number(df.t).alias("k")).first().k == number


def test_flow():
    arcs = [(0, 1, 5, 0), (0, 2, 5, 0), (1, 3, 4, 1), (1, 4, 9, 3), (2, 3, 4, 1), (2, 4, 9, 5), (3, 5, 4, 0), (4, 5, 6, 0)]
    flow = min_cost_flow(6, arcs, 0, 5)
    assert sum(flow[:2]) == 10 and sum(f * c for f, (_, _, _, c) in zip(flow, arcs)) == min(x + 3 * (5 - x) + (4 - x) + 5 * (5 - 4 + x) for x in range(5))


def test_allocation_is_whole_and_near_the_shares():
    rng = random.Random(1)
    bundles = {(rng.randrange(1, 60), rng.randrange(4)): rng.randrange(1, 30) for _ in range(120)}
    plan = allocate([(s, p, n) for (s, p), n in bundles.items()], [0.8, 0.1, 0.1])
    assert {k: sum(v) for k, v in plan.items()} == bundles
    total = sum(s * n for (s, _), n in bundles.items())
    for i, share in enumerate([0.8, 0.1, 0.1]):
        assert abs(sum(s * g[i] for (s, _), g in plan.items()) / total - share) < 0.0005
    assert allocate([(1000, 0, 1), (1, 0, 100)], [0.8, 0.1, 0.1])[1000, 0] == [1, 0, 0]


ELEMENTS = "doc_uid long, document_title string, annotator_id string, layer string, split_name string"
TARGETS = "split_name string, target_share double"


def test_splits(spark):
    targets = spark.createDataFrame([("train", 0.8), ("dev", 0.1), ("test", 0.1)], TARGETS)
    rng = random.Random(6)
    rows = []
    for uid in range(300):
        title, who = f"ab{rng.randrange(200):03}_t.txt", f"anno_{rng.randrange(400):04}"
        for _ in range(rng.randrange(1, 6)):
            rows.append((uid, rng.choice([title, title.upper(), None]), rng.choice([who, f"x/{who}.xmi", ""]), rng.choice(["event", "filler", None]), "clash"))
    rows += [(999, None, None, None, None), (None, "ab000_t", None, None, None)]
    got = {r.doc_uid: r for r in assign_splits(spark.createDataFrame(rows, ELEMENTS), targets).collect()}
    assert set(got) == {r[0] for r in rows}
    assert sum(r.n_rows for r in got.values()) == len(rows)
    pairs = []
    for uid, title, who, _, _ in rows:
        pairs.append(((1, str(uid)), (1, str(uid))))
        if title:
            pairs.append(((1, str(uid)), (2, title.lower()[:5])))
        if who:
            pairs.append(((1, str(uid)), (0, who[-4:] if "." not in who else who[-8:-4])))
    root = union_find(pairs)
    splits = {}
    for uid, r in got.items():
        least = root[1, str(uid)]
        assert r.group_annotator == (int(least[1]) if least[0] == 0 else None)
        assert splits.setdefault(least, r.split_name) == r.split_name
    assert assign_splits(spark.createDataFrame([], ELEMENTS), targets).count() == 0
