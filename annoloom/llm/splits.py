"""Splits that keep together all that shares a document or an annotator, by min-cost flow over bundles of groups.

Groups (components) of one size and label profile are interchangeable: they form a bundle. Sizes count exactly up to 1024
rows and to one part in 512 beyond, so that there are at most BUNDLES of them, whatever the data; only bundles reach the
driver. A flow from nodes of bundles (one for each profile and power of two of the size) to splits meets the quotas of rows,
overall and by profile, at least deviation cost: rows beyond a quota cost, and so do groups that are large for a split, as
they are hard to round there. The flow is rounded to whole groups, largest first, and the groups of a bundle take their
places in order of a seeded hash.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import star_components
from ..session import release, stored


def document_key(title: Column) -> Column:
    """Letters, a number, then an underscore at the start of the file name; in lower case, number without leading zeros kept as written."""
    name = F.regexp_extract(F.lower(F.trim(F.translate(title, "\\", "/"))), r"([^/]*)$", 1)
    key = F.regexp_extract(F.trim(name), r"^(\p{L}+\d+)_", 1)
    return F.when(key != "", key)


def annotator_number(annotator: Column) -> Column:
    """The first number in the last part of the id, without leading zeros; null where there is none or it is beyond bigint."""
    name = F.regexp_extract(F.translate(annotator, "\\", "/"), r"([^/]*)$", 1)
    return F.regexp_extract(name, r"0*(\d+)", 1).try_cast("long")


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Greatest flow of least cost by shortest augmenting paths with potentials. arcs: (from, to, capacity, cost >= 0); gives each arc's flow."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)
    potential = [0] * n
    while True:
        far, via, heap = [float("inf")] * n, [-1] * n, [(0, source)]
        far[source] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in out[x]:
                if cap[e] and (t := d + cost[e] + potential[x] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], via[to[e]] = t, e
                    heapq.heappush(heap, (t, to[e]))
        if via[sink] < 0:
            return [c - cap[2 * i] for i, (_, _, c, _) in enumerate(arcs)]
        potential = [p + f if f < float("inf") else p for p, f in zip(potential, far)]
        x, least = sink, float("inf")
        while x != source:
            least, x = min(least, cap[via[x]]), to[via[x] ^ 1]
        x = sink
        while x != source:
            cap[via[x]] -= least
            cap[via[x] ^ 1] += least
            x = to[via[x] ^ 1]


EXACT, PARTS = 1024, 512
BUNDLES = (EXACT + PARTS * 53) * 11  # sizes up to 2^63, in the default number of profiles


def bundle_size(size: Column) -> Column:
    """The size that a group counts as: its own up to EXACT, beyond that rounded down to one part in PARTS."""
    unit = F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double")))) / PARTS
    return F.when(size <= EXACT, size).otherwise((F.floor(size / unit) * unit).cast("long"))


def _quotas(total: int, shares: list[float]) -> list[int]:
    """Whole numbers that sum to total, by largest remainder."""
    exact = [total * s / sum(shares) for s in shares]
    whole = [int(x) for x in exact]
    for i in sorted(range(len(shares)), key=lambda i: whole[i] - exact[i])[: total - sum(whole)]:
        whole[i] += 1
    return whole


def allocate(bundles: list[tuple[int, int, int]], shares: list[float], over_cost: int = 1000, profile_cost: int = 10, large_cost: int = 64) -> dict[tuple[int, int], list[int]]:
    """bundles: (size, profile, number of groups). How many groups of each (size, profile) go to each split.

    Costs are for each row: over_cost beyond a split's quota, profile_cost beyond a profile's, large_cost times the size as
    a share of the split's quota.
    """
    total = sum(s * n for s, _, n in bundles)
    quota, k = _quotas(total, shares), len(shares)
    profiles = sorted({p for _, p, _ in bundles})
    node = lambda size, p: (p, size.bit_length())
    cost = lambda octave: [min(over_cost, large_cost * (1 << octave >> 1) // max(1, q)) for q in quota]
    classes: dict[tuple, int] = defaultdict(int)
    for size, p, n in bundles:
        classes[node(size, p)] += size * n
    names = list(classes)
    at_class, at_cell, at_split, sink = 1, 1 + len(names), 1 + len(names) + len(profiles) * k, 1 + len(names) + len(profiles) * k + k
    arcs: list[tuple[int, int, int, int]] = []
    for i, (p, octave) in enumerate(names):
        arcs.append((0, at_class + i, classes[p, octave], 0))
        arcs += [(at_class + i, at_cell + profiles.index(p) * k + s, classes[p, octave], c) for s, c in enumerate(cost(octave))]
    for j, p in enumerate(profiles):
        own = _quotas(sum(s * n for s, q, n in bundles if q == p), shares)
        for s in range(k):
            arcs += [(at_cell + j * k + s, at_split + s, own[s], 0), (at_cell + j * k + s, at_split + s, total, profile_cost)]
    for s in range(k):
        arcs += [(at_split + s, sink, quota[s], 0), (at_split + s, sink, total, over_cost)]
    flows = min_cost_flow(sink + 1, arcs, 0, sink)
    rest: dict[tuple, list[int]] = {name: [0] * k for name in names}
    for (a, b, _, _), f in zip(arcs, flows):
        if at_class <= a < at_cell:
            rest[names[a - at_class]][(b - at_cell) % k] += f
    missing = quota[:]  # rows that each split still wants
    out: dict[tuple[int, int], list[int]] = {}
    for size, p, n in sorted(bundles, reverse=True):
        want = rest[node(size, p)]
        open_rows = sum(max(0, w) for w in want) or 1
        give = [min(n, int(n * max(0, w) / open_rows), max(0, w) // size) for w in want]
        for _ in range(n - sum(give)):
            s = max(range(k), key=lambda s: (missing[s] - give[s] * size, want[s] - give[s] * size, -s))
            give[s] += 1
        for s in range(k):
            want[s] -= give[s] * size
            missing[s] -= give[s] * size
        out[size, p] = give
    # What rounding by profile left over or short in total: whole groups move, largest first, as long as they fit the gap.
    for size, p in sorted(out, reverse=True):
        give = out[size, p]
        for s in range(k):
            for t in range(k):
                moved = min(give[s], max(0, min(-missing[s], missing[t])) // size)
                give[s] -= moved
                give[t] += moved
                missing[s] += moved * size
                missing[t] -= moved * size
    return out


def assign_splits(elements: DataFrame, targets: DataFrame, seed: int = 17, profile_steps: int = 10, hash_buckets: int = 1024) -> DataFrame:
    """(doc_uid, n_rows, group_annotator, split_name): one row for each doc_uid; all doc_uids tied by a document or an annotator share a split.

    elements: doc_uid, document_title, annotator_id, layer; targets: split_name, target_share (a handful of rows). A
    doc_uid that names neither is a group of its own; group_annotator is the least annotator number of the group, null if
    it names none; rows with a null doc_uid are one document; deleted and repeated rows count as rows. The label profile
    of a group is the share of events among its rows, in profile_steps steps. No elements: no rows.
    """
    spark = elements.sparkSession
    spelled = elements.groupBy("doc_uid", "document_title", "annotator_id").agg(F.count("*").alias("n"), F.count_if(F.col("layer") == "event").alias("n_events"))
    # Annotators sort before documents and by number, so that a group's least key is its least annotator.
    parsed = stored(spelled.select(
        "doc_uid", "n", "n_events", F.concat(F.lit("d"), document_key(F.col("document_title"))).alias("d"),
        F.concat(F.lit("a"), F.lpad(annotator_number(F.col("annotator_id")).cast("string"), 19, "0")).alias("a"),
    ))
    docs = parsed.groupBy("doc_uid").agg(F.sum("n").alias("n_rows"), F.sum("n_events").alias("n_events"), F.coalesce(F.min("a"), F.min("d")).alias("anchor"))
    keys = parsed.select(F.col("doc_uid").alias("named"), F.explode(F.array("a", "d")).alias("key")).filter("key is not null").distinct()
    pairs = keys.join(docs, F.col("named").eqNullSafe(F.col("doc_uid"))).select("key", "anchor")
    groups = star_components(pairs, "key", "anchor").select(F.col("node").alias("anchor"), F.col("group").alias("root"))
    alone = F.concat(F.lit("u"), F.coalesce(F.col("doc_uid").cast("string"), F.lit("")))
    tied = stored(docs.join(groups, "anchor", "left").select("doc_uid", "n_rows", "n_events", F.coalesce("root", "anchor", alone).alias("root")))
    release(parsed)
    units = tied.groupBy("root").agg(F.sum("n_rows").alias("size"), F.sum("n_events").alias("events")).select(
        "root", bundle_size(F.col("size")).alias("size"), F.floor(F.col("events") * profile_steps / F.col("size")).cast("int").alias("profile"), F.xxhash64(F.lit(seed), "root").alias("h")
    )
    names = [(r.split_name, r.target_share) for r in targets.orderBy("split_name").collect()]
    bundles = [tuple(r) for r in units.groupBy("size", "profile").agg(F.count("*")).collect()]
    plan = allocate(bundles, [s for _, s in names]) if bundles else {}
    steps = []
    for (size, p), give in plan.items():
        start = 0
        for (name, _), g in zip(names, give):
            if g:
                steps.append((size, p, start, start + g, name))
            start += g
    chosen = spark.createDataFrame(steps, "size long, profile int, from_place long, to_place long, split_name string")
    # Places in a bundle by hash, ranked in hash_buckets parts, so that no bundle is sorted by one task.
    bucketed = units.withColumn("bucket", F.pmod(F.col("h"), F.lit(hash_buckets)))
    before = bucketed.groupBy("size", "profile", "bucket").agg(F.count("*").alias("c")).select(
        "size", "profile", "bucket", (F.sum("c").over(Window.partitionBy("size", "profile").orderBy("bucket")) - F.col("c")).alias("before")
    )
    placed = bucketed.join(before, ["size", "profile", "bucket"]).select(
        "root", "size", "profile", (F.col("before") + F.row_number().over(Window.partitionBy("size", "profile", "bucket").orderBy("h", "root")) - 1).alias("place")
    )
    split_of = placed.join(chosen, ["size", "profile"]).filter("place >= from_place and place < to_place").select("root", "split_name")
    return tied.join(split_of, "root").select(
        "doc_uid", "n_rows", F.when(F.col("root").startswith("a"), F.substring("root", 2, 19).cast("long")).alias("group_annotator"), "split_name"
    )
