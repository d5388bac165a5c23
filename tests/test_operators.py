"""Operators against worked cases, published numbers and plain re-computations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from annoloom.functions import scalars
from annoloom.operators import agreement, alignment, dedupe, graph, lexical, matching, relations, scoring, stats
from annoloom.operators import spans as sp


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def tokens(spark, n):
    return spark.createDataFrame([(1, i, f"t{i}") for i in range(n)], "doc_id long, tok_idx int, tok string")


@pytest.mark.parametrize("units, tags", [([(0, 1), (3, 4)], "B I O B I O"), ([(0, 2), (3, 4)], "B I I B I O"), ([(0, 2), (2, 4)], "B I B I I O"), ([], "O O O O O O"), ([(None, 2)], "O O O O O O")])
def test_bio(spark, units, tags):
    u = spark.createDataFrame([(1, a, b, i) for i, (a, b) in enumerate(units)], "doc_id long, first int, last int, ord int")
    out = sp.bio_tags(tokens(spark, 6), u, ["doc_id"], "ord").orderBy("tok_idx").collect()
    assert " ".join(r.tag for r in out) == tags


@pytest.mark.parametrize("x, y, want", [([{1, 2}, {2}], [{1}, {2}], [[0.667, 0.667], [0, 1]]), ([{1}, {2}], [{1, 2}, {2}], [[0.667, 0], [0.667, 1]]), ([{1}, {2}], [{1, 2}, {2, 3}], [[0.667, 0], [0.667, 0.667]])])
def test_dice(spark, x, y, want):
    cells = [(i, j, sorted(a), sorted(b)) for i, a in enumerate(x) for j, b in enumerate(y)]
    df = spark.createDataFrame([*cells, (9, 9, [], [1]), (9, 8, None, [1])], "i int, j int, a array<int>, b array<int>").select("i", "j", sp.dice(F.col("a"), F.col("b")).alias("d"))
    got = {(r.i, r.j): round(r.d, 3) for r in df.collect()}
    assert got == {(i, j): want[i][j] for i in range(2) for j in range(2)} | {(9, 9): 0, (9, 8): 0}


def test_interval_union(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (1, 3, 4), (1, None, 4), (2, 0, 9), (2, 1, 2), (2, 8, 12)], "k int, b int, e int")
    apart = {(r.k, r.b): r.group_no for r in sp.interval_union(df, ["k"], "b", "e").collect()}
    assert apart == {(1, 0): 1, (1, 1): 1, (1, 3): 2, (1, None): None, (2, 0): 1, (2, 1): 1, (2, 8): 1}
    joined = {(r.k, r.b): r.group_no for r in sp.interval_union(df, ["k"], "b", "e", touching=True).collect()}
    assert joined[1, 3] == 1


def random_spans(seed, who, n=60):
    rng = random.Random(seed)
    return [(d, who, i, a := rng.randrange(60), a + rng.randrange(6), rng.choice(["x", "y", None])) for d in (1, 2) for i in range(n // 2)]


def test_matching_against_loops(spark):
    gold, system = random_spans(1, 0), random_spans(2, 1)
    g = spark.createDataFrame([(d, i, a, b, lb) for d, _, i, a, b, lb in gold], "doc_id long, gold_id int, first int, last int, label string")
    s = spark.createDataFrame(system, "doc_id long, annotator int, sys_id int, first int, last int, label string")

    def dice(x, y):
        shared = min(x[4], y[4]) - max(x[3], y[3]) + 1
        return 2 * shared / (x[4] - x[3] + y[4] - y[3] + 2) if shared > 0 else 0

    taken, pairs = set(), []
    for x in gold:
        for y in system:
            if x[0] == y[0] and dice(x, y) > 0 and (y[0], y[2]) not in taken:
                taken.add((y[0], y[2]))
                pairs.append((x, y, dice(x, y)))
    best = [(x[0], 1, x[2], y[2], round(d, 9)) for x, y, d in pairs if d == max(e for z, _, e in pairs if z == x)]
    got = matching.match(g, s).withColumn("dice", F.round("dice", 9))
    assert rows(got) == sorted(best, key=str)
    sums = scoring.nugget_sums(g, s, matching.match(g, s), ["label"]).collect()
    assert sum(r.n_gold for r in sums) == len(gold) and abs(sum(r.tp for r in sums) - sum(max(d for z, _, d in pairs if z == x) for x in gold if any(z == x for z, _, _ in pairs))) < 1e-9
    assert rows(scoring.prf(sums and scoring.nugget_sums(g, s, matching.match(g, s), ["label"]), ["label"]).select("p", "r"))
    with pytest.raises(ValueError):
        matching.match(g, s, "nothing")


def test_empty_sides(spark):
    g = spark.createDataFrame([], "doc_id long, gold_id int, first int, last int, label string")
    s = spark.createDataFrame([(1, 1, 1, 0, 2, "x")], "doc_id long, annotator int, sys_id int, first int, last int, label string")
    assert rows(matching.match(g, s)) == []
    assert rows(scoring.nugget_sums(g, s, matching.match(g, s), ["label"])) == []


def test_self_overlap():
    assert alignment.resolve_group([(0, 1, 0, 0, "x"), (0, 3, 1, 1, "x"), (2, 3, 0, 2, "y")]) == [1, 1, 2]
    assert alignment.resolve_group([(0, 1, 0, 0, "x"), (0, 1, 0, 5, "y"), (0, 1, 1, 1, "y")]) == [1, 2, 2]
    assert alignment.resolve_group([(0, 5, 0, 0, "x"), (2, 3, 0, 1, "x")]) == [1, 2]


RATINGS = "coder string, item int, label string"


def plain_kappa(data):
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    full = [i for i in data if all(data[i].get(c) for c in "abc")]
    ks, aos, aes = [], [], []
    for x, y in pairs:
        ao = sum(data[i][x] == data[i][y] for i in full) / len(full)
        ae = sum(sum(data[i][x] == k for i in full) * sum(data[i][y] == k for i in full) for k in "pqr") / len(full) ** 2
        ks.append((ao - ae) / (1 - ae))
        aos.append(ao)
        aes.append(ae)
    mean = lambda v: sum(v) / len(v)
    return len(full), mean(aos), mean(ks), (mean(aos) - mean(aes)) / (1 - mean(aes))


def test_agreement(spark):
    rng = random.Random(5)
    data = {i: {c: rng.choice("pqr" if rng.random() < 0.4 else "p") for c in "abc" if rng.random() < 0.9} for i in range(80)}
    df = spark.createDataFrame([(c, i, lb) for i, cell in data.items() for c, lb in cell.items()] + [("a", 999, None), (None, 1, "p")], RATINGS)
    row = agreement.coefficients(df).first()
    assert [round(x, 9) for x in (row.n_items, row.mean_ao, row.kappa, row.multi_kappa)] == [round(x, 9) for x in plain_kappa(data)]
    pairable = [list(c.values()) for c in data.values() if len(c) > 1]
    n = sum(map(len, pairable))
    do = sum(sum(x != y for k, x in enumerate(v) for j, y in enumerate(v) if j != k) / (len(v) - 1) for v in pairable) / n
    every = [x for v in pairable for x in v]
    de = sum(every.count(a) * every.count(b) for a in "pqr" for b in "pqr" if a != b) / (n * (n - 1))
    assert abs(agreement.krippendorff_alpha(df).first().alpha - (1 - do / de)) < 1e-9
    micro = {(r.a, r.b): r.precision for r in agreement.pairwise_prf(df).filter("label is null").collect()}
    ao = {(r.a, r.b): r.ao for r in agreement.pairwise_agreement(agreement.complete_items(df)).collect()}
    assert all(abs(micro[k] - ao[k]) < 1e-9 for k in ao)
    empty = spark.createDataFrame([], RATINGS)
    assert rows(agreement.coefficients(empty)) == [] and rows(agreement.krippendorff_alpha(empty)) == []


@pytest.mark.parametrize("w, t, want", [(516, 324, (0.6279, 0.01193)), (1160, 479, (0.4129, 0.01776)), (154, 29, (0.1883, 0.06581))])
def test_published_richness(spark, w, t, want):
    df = spark.createDataFrame([("g", str(min(i, t - 1))) for i in range(w)], "g string, tok string")
    row = lexical.basic_richness(df, ["g"]).first()
    assert (round(row.ttr, 4), round(row.maas, 5)) == want


def test_lexical_against_loops(spark):
    rng = random.Random(2)
    words = [rng.choice("abcdefghijklmnopq") for _ in range(150)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(words)] + [(2, 0, "a"), (2, 1, None)], "g int, p int, tok string")
    runs = [len(set(words[i : i + 25])) / 25 for i in range(len(words) - 24)]
    assert abs(lexical.mattr(df, ["g"], ["p"]).first().mattr - sum(runs) / len(runs)) < 1e-9
    assert abs(lexical.msttr(df, ["g"], ["p"]).first().msttr - sum(runs[::25]) / 6) < 1e-9
    n, counts = len(words), [words.count(x) for x in set(words)]
    want = sum(1 - math.comb(n - c, 42) / math.comb(n, 42) for c in counts) / 42
    assert abs(lexical.hdd(df, ["g"]).first().hdd - want) < 1e-9
    mtld = {r.g: r.mtld for r in lexical.mtld(df, ["g"], ["p"]).collect()}
    assert mtld[1] > 1 and mtld[2] is None
    entropy = {r.g: r.entropy for r in lexical.entropy(df, ["g"], "tok").collect()}
    assert abs(entropy[1] + sum(c / n * math.log2(c / n) for c in counts)) < 1e-9


def test_average_rank(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 3.0), ("d", 1.0), ("e", None)], "k string, v double")
    assert {r.k: r.r for r in df.withColumn("r", lexical.average_rank("v")).collect()} == {"a": 1, "b": 2, "c": 2, "d": 4, "e": None}


def test_components(spark):
    df = spark.createDataFrame([(1, 3, 2), (1, 2, 1), (1, 8, 9), (2, 3, 1), (1, 5, 5), (1, None, 4)], "s int, a int, b int")
    assert rows(graph.star_components(df, "a", "b", ["s"])) == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 8, 8), (1, 9, 8), (2, 1, 1), (2, 3, 1)]


def test_relations(spark):
    e = spark.createDataFrame([(1, 1, "a", 0, 9, 5, None), (1, 1, "b", 0, 9, 7, None), (1, 2, "c", 2, 4, 5, None), (1, 2, "c", 2, 4, 6, 6), (1, 3, "d", 2, 4, 1, None)], "doc_uid int, element_id int, text string, begin_pos int, end_pos int, ingested_at int, deleted_at int")
    now = relations.current(e, ["doc_uid", "element_id"], ["text", "begin_pos", "end_pos"])
    assert rows(now) == [(1, 1, "b", 0, 9), (1, 3, "d", 2, 4)]
    inner = now.withColumnRenamed("element_id", "inner_id")
    assert rows(relations.contained(inner, now.withColumnRenamed("element_id", "outer_id"), ["doc_uid"], bucket=3).select("inner_id", "outer_id")) == [(1, 1), (3, 1), (3, 3)]
    links = spark.createDataFrame([(1, 70, 1), (1, 71, 1), (1, 72, 9)], "doc_uid int, link_id int, target_id int")
    assert rows(relations.linked(now, links).select("element_id", "link_id")) == [(1, 70), (1, 71)]
    lists = spark.createDataFrame([(1, 5, " 70  72 x 99 "), (1, 6, ""), (1, 7, None)], "doc_uid int, event_id int, ids string")
    assert rows(relations.by_id_list(lists, "ids", links, ["doc_uid"], "link_id").select("event_id", "link_id")) == [(5, 70), (5, 72)]


def test_scalars(spark):
    df = spark.createDataFrame([("false", "false", "+Positive"), ("true", "true", "-Negative"), (None, "odd", None)], "m string, p string, s string")
    out = df.select(scalars.realis(scalars.polarity(F.col("p")), scalars.modality(F.col("m"))).alias("r"), scalars.scoped_sentiment(scalars.sentiment(F.col("s")), F.col("p") == "true").alias("x"))
    assert [tuple(r) for r in out.collect()] == [("asserted", "positive"), ("other", "positive"), ("other", None)]
    toks = spark.createDataFrame([([("DET", "det", False), ("NOUN", "nsubj", False), ("VERB", "ROOT", True), ("ADP", "prep", False)],)], "t array<struct<pos: string, dep: string, root: boolean>>")
    assert toks.select(scalars.truncated(F.col("t"), 2).alias("x")).first().x == 1
    assert toks.select(scalars.truncated(F.col("t"), 5).alias("x")).first().x is None
    assert toks.select(scalars.pronominal(F.array(F.lit("PRP"), F.lit("WP"))).alias("x")).first().x is True


def test_stats(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None), ("b", "x")], "k string, v string")
    assert rows(stats.type_rollup(df, "k", "v")) == [("a", "unspecified", 1), ("a", "x", 1), ("a", "y", 1), ("a", None, 3), ("b", "x", 1)]
    values = spark.createDataFrame([(v,) for v in (1, 2, 2, 3)], "v int")
    assert {r.v: r.percentile for r in stats.percentile_ranks(values, "v").collect()} == {1: 25.0, 2: 62.5, 3: 100.0}


def test_dedupe(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, "x"), (4, None, "y")], "i int, k string, v string")
    split = {r.i: r.split for r in dedupe.one_per_group(df, "k", "i").collect()}
    assert len(split) == 4 and sorted(split.values()).count("dev") == 2
    assert rows(dedupe.difference(df, df.filter("i < 3"), "k")) == [(None, "left")]
