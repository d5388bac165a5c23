"""Mixing sources to target shares of all tokens: hierarchical budgets, then seeded epochs.

Weights go down a tree of domains, languages and sources; what a leaf can't give, even repeated as often as allowed, its
siblings take over in proportion to their weights, then their parents' siblings, up to the root. A leaf with budget B
gives each of its texts in every full epoch and the first texts of one more seeded order up to the rest of B. Only the
tree, a few rows for each source, reaches the driver.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

def source_key(source: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one underscore, none at the ends; null for nothing."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", ""), F.lit(""))


def _pour(amount: float, weights: list[float], room: list[float]) -> list[float]:
    """amount shared out by weight, none above its room; what nobody has room for stays out."""
    given = [0.0] * len(weights)
    live = [i for i, w in enumerate(weights) if w > 0 and room[i] > 0]
    while live and amount > 1e-9:
        total = sum(weights[i] for i in live)
        full = [i for i in live if room[i] - given[i] <= amount * weights[i] / total]
        if not full:
            for i in live:
                given[i] += amount * weights[i] / total
            break
        for i in full:
            amount -= room[i] - given[i]
            given[i] = room[i]
        live = [i for i in live if i not in full]
    return given


def budgets(leaves: list[tuple[tuple, float, float]], total: float) -> dict[tuple, float]:
    """leaves: (path, weight, capacity), paths of one length. Each leaf's budget; a shortage goes to siblings before it goes up."""
    got = {path: min(total * w, cap) for path, w, cap in leaves}
    weight, cap = {p: w for p, w, _ in leaves}, {p: c for p, _, c in leaves}
    depth = len(leaves[0][0]) if leaves else 0
    short = {p: total * weight[p] - got[p] for p in got}
    for level in range(depth - 1, -1, -1):
        groups: dict[tuple, list[tuple]] = defaultdict(list)
        for p in got:
            groups[p[:level]].append(p)
        rising: dict[tuple, float] = {}
        for node, paths in groups.items():
            lacking = sum(short.pop(k) for k in [k for k in short if k[:level] == node])
            extra = _pour(lacking, [weight[p] for p in paths], [cap[p] - got[p] for p in paths])
            for p, x in zip(paths, extra):
                got[p] += x
            rising[node] = lacking - sum(extra)
        short = rising
    return got


def mix(texts: DataFrame, targets: DataFrame, domains: DataFrame | None = None, budget_tokens: int | None = None, seed: int = 11, hash_buckets: int = 4096) -> DataFrame:
    """(doc_id, source, lang, epoch, n_tokens): a row for each time a text is drawn.

    texts: doc_id, source, lang, n_tokens, text_key; targets: source, target_share, max_repeats (a row for each source;
    null or less than 1 repeat: nothing is drawn); domains: source, domain, the upper level of the tree, a row for each
    source (of several the least domain; a source without one is a domain of its own). A language is the part of lang
    before "-" or "_", "und" where there is none of two or three letters. Texts of one text_key are copies: the one of least doc_id, if it can in
    a targeted source, stands for all, so that none is drawn more often than allowed under another id. Texts of no tokens
    and of untargeted sources are not drawn. budget_tokens is the size of the mix, by default that of the distinct texts
    of targeted sources. A leaf's last epoch ends where its tokens come nearest to its budget.
    """
    spark = texts.sparkSession
    wanted = targets.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).filter("source is not null")
    aims = {r.source: (r.share or 0.0, max(0, r.repeats or 0)) for r in wanted.collect()}
    domain_of: dict[str, str] = {}
    if domains is not None:  # a row for each targeted source at most
        named = domains.select(source_key(F.col("source")).alias("source"), "domain").filter(F.col("source").isin(list(aims))).groupBy("source").agg(F.min("domain").alias("domain"))
        domain_of = {r.source: r.domain for r in named.collect() if r.domain}
    lang = F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim("lang")), "^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit("")), F.lit("und"))
    rows = texts.filter("n_tokens > 0").select("text_key", "n_tokens", "doc_id", source_key(F.col("source")).alias("source"), lang.alias("lang"))
    rows = rows.withColumn("outside", ~F.coalesce(F.col("source").isin(list(aims)), F.lit(False)))
    single = stored(
        rows.groupBy("text_key").agg(F.min(F.struct("outside", "doc_id", "source", "lang", "n_tokens")).alias("x")).select("x.*").filter("not outside").drop("outside")
    )
    sizes = {(r.source, r.lang): r.n for r in single.groupBy("source", "lang").agg(F.sum("n_tokens").alias("n")).collect()}
    of_source: dict[str, int] = defaultdict(int)
    for (s, _), n in sizes.items():
        of_source[s] += n
    total = budget_tokens if budget_tokens is not None else sum(sizes.values())
    scale = sum(share for share, _ in aims.values()) or 1.0
    leaves = [((domain_of.get(s, s), lg, s), aims[s][0] / scale * n / of_source[s], float(n * aims[s][1])) for (s, lg), n in sorted(sizes.items())]
    leaves += [((domain_of.get(s, s), "und", s), aims[s][0] / scale, 0.0) for s in sorted(aims) if s not in of_source]
    plan = [(s, lg, int(b // sizes[s, lg]), int(b % sizes[s, lg])) for (_, lg, s), b in budgets(leaves, total).items() if (s, lg) in sizes]
    leaf = spark.createDataFrame(plan, "source string, lang string, full int, rest long")
    # The prefix of the last epoch, in order of a seeded hash: sums of hash buckets, then a running sum inside each bucket.
    # Broadcast: a row for each targeted source and language code of two or three letters, never more than that.
    drawn = single.join(F.broadcast(leaf), ["source", "lang"]).withColumn("h", F.xxhash64(F.lit(seed), "full", "doc_id")).withColumn("bucket", F.pmod("h", F.lit(hash_buckets)))
    sums = drawn.groupBy("source", "lang", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = sums.select("source", "lang", "bucket", (F.sum("in_bucket").over(Window.partitionBy("source", "lang").orderBy("bucket")) - F.col("in_bucket")).alias("before"))
    running = F.sum("n_tokens").over(Window.partitionBy("source", "lang", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    counted = drawn.join(before, ["source", "lang", "bucket"]).withColumn("upto", F.col("before") + running)
    times = F.col("full") + F.when(2 * F.col("upto") - F.col("n_tokens") <= 2 * F.col("rest"), 1).otherwise(0)
    return counted.select("doc_id", "source", "lang", F.explode(F.sequence(F.lit(0), times)).alias("epoch"), "n_tokens").filter("epoch > 0")


def share_report(texts: DataFrame, mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target share, tokens there are, tokens drawn, share reached, most repeats of a text."""
    there = texts.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("n_tokens").alias("tokens_there"))
    per_text = mixed.groupBy("source", "doc_id").agg(F.max("epoch").alias("repeats"), F.sum("n_tokens").alias("n"))
    reached = per_text.groupBy("source").agg(F.sum("n").alias("tokens_drawn"), F.count("*").alias("n_texts"), F.max("repeats").alias("most_repeats"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    wanted = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    joined = wanted.join(there, "source", "left").join(reached, "source", "left").select("source", "target_share", "max_repeats", zero("tokens_there"), zero("tokens_drawn"), zero("n_texts"), zero("most_repeats"))
    return joined.withColumn("share_reached", F.try_divide("tokens_drawn", F.sum("tokens_drawn").over(Window.partitionBy(F.lit(1)))))
