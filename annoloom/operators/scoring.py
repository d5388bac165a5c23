"""Nugget scores of matched spans: true and false positives, precision, recall, F1 and accuracies, and their means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["doc_id", "annotator"]


def nugget_sums(gold: DataFrame, system: DataFrame, matches: DataFrame, attributes: list[str]) -> DataFrame:
    """Sums for each (doc_id, annotator) with a gold span: matched dice, counts, attribute hits. NULL equals NULL as an attribute; of tied best spans the first one stands for 'all attributes'."""
    g = gold.select("doc_id", "gold_id", *(F.col(a).alias(f"g_{a}") for a in attributes))
    s = system.select(*PAIR, "sys_id", *(F.col(a).alias(f"s_{a}") for a in attributes))
    hit = {a: F.col(f"g_{a}").eqNullSafe(F.col(f"s_{a}")) for a in attributes}
    every = reduce(Column.__and__, hit.values())
    rows = matches.join(g, ["doc_id", "gold_id"]).join(s, [*PAIR, "sys_id"]).select(*PAIR, "gold_id", "sys_id", "dice", every.alias("all_hit"), *(h.alias(f"hit_{a}") for a, h in hit.items()))
    one = lambda c, value: F.sum(F.when(F.col(c), value).otherwise(0.0))
    per_gold = rows.groupBy(*PAIR, "gold_id").agg(
        F.count("*").alias("k"), F.max("dice").alias("d"), F.min_by("all_hit", "sys_id").alias("first_hit"), one("all_hit", F.lit(1.0)).alias("h_all"),
        *(one(f"hit_{a}", F.lit(1.0)).alias(f"h_{a}") for a in attributes), *(one(f"hit_{a}", F.col("dice")).alias(f"d_{a}") for a in attributes),
    )
    n_system = system.groupBy(*PAIR).agg(F.count("*").alias("n_system"))
    base = n_system.join(gold.select("doc_id", "gold_id"), "doc_id").join(per_gold, [*PAIR, "gold_id"], "left")
    on, off = F.col("k").isNotNull(), F.col("k").isNull()
    total = lambda cond, value: F.sum(F.when(cond, value).otherwise(0.0))
    sums = [
        total(on, F.col("d")).alias("tp"), total(off, 1.0).alias("fp"), total(on, 1.0).alias("tp_relaxed"),
        total(F.col("first_hit"), F.col("d")).alias("tp_attrib"), total(F.col("first_hit"), 1.0).alias("tp_attrib_relaxed"), total(off | ~F.col("first_hit"), 1.0).alias("fp_attrib"),
        total(on, F.col("h_all") / F.col("k")).alias("acc_allattrib"),
    ]
    for a in attributes:
        sums += [total(on, F.col(f"d_{a}")).alias(f"tp_{a}"), (total(on, F.col("k") - F.col(f"h_{a}")) + total(off, 1.0)).alias(f"fp_{a}"), total(on, F.col(f"h_{a}") / F.col("k")).alias(f"acc_{a}")]
    return base.groupBy(*PAIR).agg(F.count("*").alias("n_gold"), F.max("n_system").alias("n_system"), *sums)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def prf(sums: DataFrame, attributes: list[str], digits: int | None = None) -> DataFrame:
    """Precision, recall and F1 of spans and of each kind of hit; 0 where a ratio has no denominator. The false positives of the kinds are the spans'."""
    c = F.col
    out = {"r": _ratio(c("tp"), c("n_gold")), "p": _ratio(c("tp"), c("tp") + c("fp")), "p_alt": _ratio(c("tp"), c("n_system"))}
    for m in ("relaxed", "attrib", "attrib_relaxed", *attributes):
        tp = c(f"tp_{m}")
        out |= {f"r_{m}": _ratio(tp, c("n_gold")), f"p_{m}": _ratio(tp, tp + c("fp")), f"p_{m}_alt": _ratio(tp, c("n_system"))}
    for name in [k for k in out if k[0] == "p"]:
        r = out["r" + name[1:].removesuffix("_alt")]
        out["f1" + name[1:]] = _ratio(2 * out[name] * r, out[name] + r)
    for m in ("allattrib", *attributes):
        out[f"acc_{m}"] = _ratio(c(f"acc_{m}"), c("n_system"))
    return sums.select(*PAIR, "n_gold", "n_system", *((F.round(v, digits) if digits else v).alias(k) for k, v in out.items()))


def mean_scores(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Means over all rows, by annotator and by document, in one pass of grouping sets; level says which."""
    spread = scores.select(F.explode(F.array(*(F.struct(F.lit(lv).alias("level"), a.alias("annotator"), d.alias("doc_id")) for lv, a, d in (
        ("all", F.lit(None).cast("int"), F.lit(None).cast("long")), ("annotator", F.col("annotator"), F.lit(None).cast("long")), ("doc", F.lit(None).cast("int"), F.col("doc_id")))))).alias("g"), *columns)
    return spread.groupBy("g.level", "g.annotator", "g.doc_id").agg(F.count("*").alias("n"), *(F.avg(x).alias(x) for x in columns))


def confusion(gold: DataFrame, system: DataFrame, matches: DataFrame, label: str = "label") -> DataFrame:
    """Gold label against the label of the first best span or 'None': (annotator, gold_label, sys_label, n, row_share)."""
    first = matches.groupBy(*PAIR, "gold_id").agg(F.min_by("sys_id", F.struct(-F.col("dice"), F.col("sys_id"))).alias("sys_id"))
    named = first.join(system.select(*PAIR, "sys_id", F.col(label).alias("sys_label")), [*PAIR, "sys_id"])
    base = system.select(*PAIR).distinct().join(gold.select("doc_id", "gold_id", F.col(label).alias("gold_label")), "doc_id").join(named, [*PAIR, "gold_id"], "left")
    counted = base.groupBy("annotator", "gold_label", F.coalesce("sys_label", F.lit("None")).alias("sys_label")).agg(F.count("*").alias("n"))
    return counted.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy("annotator", "gold_label")))


def corpus_scores(sums: DataFrame) -> DataFrame:
    """The older corpus-level scores by annotator: sums first, then ratios; accuracies over matches."""
    total = sums.groupBy("annotator").agg(*(F.sum(x).alias(x) for x in ("n_gold", "n_system", "tp", "fp", "tp_relaxed", "tp_attrib", "fp_attrib", "acc_allattrib")))
    c = F.col
    p, r, pa, ra = _ratio(c("tp"), c("tp") + c("fp")), _ratio(c("tp"), c("n_gold")), _ratio(c("tp_attrib"), c("tp_attrib") + c("fp_attrib")), _ratio(c("tp_attrib"), c("n_gold"))
    return total.select(
        "annotator", "n_gold", "n_system", c("tp_relaxed").alias("n_matched"), p.alias("p"), r.alias("r"), _ratio(2 * p * r, p + r).alias("f1"),
        pa.alias("p_attrib"), ra.alias("r_attrib"), _ratio(2 * pa * ra, pa + ra).alias("f1_attrib"), _ratio(c("acc_allattrib"), c("tp_relaxed")).alias("acc_allattrib"), _ratio(c("tp_relaxed"), c("n_gold")).alias("matched_share"),
    )


def ranked_by_type(matches: DataFrame, gold: DataFrame, type_col: str = "label") -> DataFrame:
    """Matched share and mean dice of gold spans of each type and annotator, with the rank of the share among the annotator's types, ties averaged and cut."""
    best = matches.groupBy(*PAIR, "gold_id").agg(F.max("dice").alias("d"))
    base = best.select(*PAIR).distinct().join(gold.select("doc_id", "gold_id", type_col), "doc_id").join(best, [*PAIR, "gold_id"], "left")
    per = base.groupBy("annotator", type_col).agg(F.count("*").alias("n_gold"), F.count("d").alias("n_matched"), F.avg(F.coalesce("d", F.lit(0.0))).alias("mean_dice"))
    share = per.withColumn("share", F.col("n_matched") / F.col("n_gold"))
    ties = F.count("*").over(Window.partitionBy("annotator", "share"))
    return share.withColumn("rank", F.floor(F.rank().over(Window.partitionBy("annotator").orderBy(F.desc("share"))) + (ties - 1) / 2).cast("int"))


def spurious_ratios(errors: DataFrame, by: list[str], kind: str) -> DataFrame:
    """n and percent of each error kind in each group."""
    counted = errors.groupBy(*by, kind).agg(F.count("*").alias("n"))
    return counted.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
