"""Containers and mixtures: nothing lost, nothing over a limit, and near the targets."""

import random
from collections import Counter, defaultdict

from annoloom.llm.mixing import budgets, mix, share_report
from annoloom.llm.packing import Packer, fill_report, pack
from annoloom.llm.tokens import token_count

CAPACITIES = "capacity_name string, capacity_tokens int"


def test_packer_is_best_fit_of_bounded_space():
    rng = random.Random(2)
    packer, used, space = Packer(100, 4), Counter(), []  # space: what the open bins have free
    for _ in range(2000):
        size = rng.randrange(1, 101)
        fits = [free for free in space if free >= size]
        used[packer.put(size)] += size
        if fits:
            taken = min(fits)
            space.remove(taken)
        else:
            if len(space) == 4:
                space.remove(min(space))
            taken = 100
        space += [taken - size] * (taken > size)
        assert sorted(space) == sorted(f for f, own in packer.bins.items() for _ in own) and packer.open == len(space) <= 4
    assert max(used.values()) <= 100


def test_pack(spark):
    rng = random.Random(3)
    items = [(i, rng.choice([0, None, 1, 7, 100, 101, 350, rng.randrange(1, 300)]), "x") for i in range(800)] + [(5, 40, "x"), (5, 40, "x")]
    df = spark.createDataFrame(items, "item_id long, n_tokens long, container_id string")
    caps = spark.createDataFrame([("s", 100), ("l", 250), ("none", 0), ("null", None)], CAPACITIES)
    rows = pack(df, caps, open_bins=8, tokens_per_shard=20_000).collect()
    for name, capacity in (("s", 100), ("l", 250)):
        own = [r for r in rows if r.capacity_name == name]
        fill, got = Counter(), Counter()
        for r in own:
            got[r.item_id] += r.n_tokens
            if r.container_id is None:
                assert r.n_tokens == 0
            else:
                fill[r.container_id] += r.n_tokens
        want = Counter()
        for i, n, _ in items:
            want[i] += n or 0
        assert dict(got) == dict(want) and max(fill.values()) <= capacity
        pieces = defaultdict(list)
        for r in own:
            pieces[r.item_id].append(r)
        for i, n, _ in items[6:800]:
            assert len(pieces[i]) == max(1, -(-(n or 0) // capacity))
        assert sum(fill.values()) / (len(fill) * capacity) > 0.9
    report = {r.capacity_name: r for r in fill_report(pack(df, caps, 8, 20_000)).collect()}
    assert set(report) == {"s", "l"} and all(r.unused_share < 0.1 for r in report.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, pack(df, caps, 8, 20_000).collect())) if all(r.container_id for r in rows) else True
    assert pack(df.limit(0), caps).count() == 0 and pack(df, caps.limit(0)).count() == 0


def test_token_count(spark):
    texts = [None, "", "a", "one two", "<|endoftext|>", "x" * 1_000_000, "日本語"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    n = [r.n for r in df.select("i", token_count(df.t).alias("n")).orderBy("i").collect()]
    assert n[:4] == [0, 0, 1, 2] and n[4] > 1 and n[5] > 1000 and n[6] > 0


def test_budgets_go_to_siblings_first():
    leaves = [(("d", "en", "a"), 0.3, 100.0), (("d", "en", "b"), 0.3, 900.0), (("d", "nl", "c"), 0.2, 900.0), (("e", "en", "f"), 0.2, 900.0)]
    assert {k[2]: round(v) for k, v in budgets(leaves, 1000).items()} == {"a": 100, "b": 500, "c": 200, "f": 200}
    leaves[1] = (("d", "en", "b"), 0.3, 350.0)
    assert {k[2]: round(v) for k, v in budgets(leaves, 1000).items()} == {"a": 100, "b": 350, "c": 350, "f": 200}
    assert round(sum(budgets([(("d", "en", "a"), 1.0, 10.0)], 1000).values())) == 10
    assert budgets([], 5) == {}


TEXTS = "doc_id long, source string, lang string, n_tokens long, text_key string, epoch int"
MIX = "source string, target_share double, max_repeats int"


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["Big Press", "big_press", "small"] if i % 10 else ["small", None, "other"]), rng.choice(["en", "EN", None, "nl"]), rng.randrange(0, 60), f"k{i // 2 if i % 5 == 0 else i}", 9) for i in range(4000)]
    texts = spark.createDataFrame(rows, TEXTS)
    targets = spark.createDataFrame([("big press", 0.4, 1), ("small", 0.5, 3), ("absent", 0.1, 2)], MIX)
    mixed = mix(texts, targets)
    out = mixed.collect()
    by_text, size = Counter(), Counter()
    key = {r[0]: r[4] for r in rows}
    for r in out:
        by_text[key[r.doc_id], r.source] += 1
        size[r.source] += r.n_tokens
    assert max(n for (_, s), n in by_text.items() if s == "big_press") == 1 and max(by_text.values()) <= 3
    assert len({k for k, _ in by_text}) == len(by_text)
    report = {r.source: r for r in share_report(texts, mixed, targets).collect()}
    assert set(report) == {"big_press", "small", "absent"} and report["absent"].tokens_drawn == 0
    assert abs(sum(r.share_reached for r in report.values()) - 1) < 1e-9
    small = mix(texts, targets, budget_tokens=3000).collect()
    total = sum(r.n_tokens for r in small)
    assert abs(total - 3000) < 300 and abs(sum(r.n_tokens for r in small if r.source == "small") / total - 0.5 / 0.9) < 0.1
    assert sorted(map(tuple, out)) == sorted(map(tuple, mix(texts.repartition(3), targets).collect()))
    assert mix(texts.limit(0), targets).count() == 0 and mix(texts, targets.limit(0)).count() == 0
