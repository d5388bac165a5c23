"""Agreement of coders on (coder, item, label) ratings; a null label is a missing one, repeated ratings of one cell count once (the greatest label).

Coefficients other than alpha take the items that every coder rated. Pairs of coders come from a self-join on the item,
so their number is that of an item's labels squared, never a product of the table. No complete item: no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cells(ratings: DataFrame) -> DataFrame:
    return ratings.filter("label is not null and item is not null and coder is not null").groupBy("item", "coder").agg(F.max("label").alias("label"))


def complete_items(ratings: DataFrame) -> DataFrame:
    """The cells of items that all coders of the table rated."""
    all_cells = cells(ratings)
    n = all_cells.agg(F.countDistinct("coder").alias("n_coders"))
    full = all_cells.groupBy("item").agg(F.count("*").alias("n")).join(F.broadcast(n), F.col("n") == F.col("n_coders"))  # one row
    return all_cells.join(full, "item", "left_semi")


def beside(*rows: DataFrame) -> DataFrame:
    """One-row frames of different columns as one row, without a join."""
    union = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)
    return union.agg(*(F.max(c).alias(c) for c in union.columns))


def coder_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, item, label_a, label_b) for a < b."""
    a = rows.select("item", F.col("coder").alias("a"), F.col("label").alias("label_a"))
    b = rows.select("item", F.col("coder").alias("b"), F.col("label").alias("label_b"))
    return a.join(b, "item").filter("a < b")


def pairwise_agreement(rows: DataFrame) -> DataFrame:
    """(a, b, ao, ae): observed share of equal labels and the share expected from the two coders' own label shares."""
    pairs = coder_pairs(rows)
    tallies = pairs.groupBy("a", "b", "label_a", "label_b").agg(F.count("*").alias("n"))
    same = F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)
    seen = tallies.groupBy("a", "b").agg(F.sum("n").alias("total"), F.sum(same).alias("equal"))
    left = tallies.groupBy("a", "b", F.col("label_a").alias("label")).agg(F.sum("n").alias("na"))
    right = tallies.groupBy("a", "b", F.col("label_b").alias("label")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, ["a", "b", "label"]).groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("products"))
    return seen.join(chance, ["a", "b"], "left").select("a", "b", (F.col("equal") / F.col("total")).alias("ao"), (F.coalesce("products", F.lit(0)) / (F.col("total") * F.col("total"))).alias("ae"))


def coefficients(ratings: DataFrame) -> DataFrame:
    """One row: n_items, mean_ao, kappa (mean pairwise Cohen; weighted kappa with a binary distance is the same), multi_kappa (Davies-Fleiss), multi_pi, s."""
    rows = complete_items(ratings)
    pairs = pairwise_agreement(rows)
    kappa = F.try_divide(F.col("ao") - F.col("ae"), 1 - F.col("ae"))
    by_pair = pairs.agg(F.avg("ao").alias("mean_ao"), F.avg("ae").alias("mean_ae"), F.avg(kappa).alias("kappa"))
    labels = rows.groupBy("label").agg(F.count("*").alias("n"))
    marginal = labels.agg(F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("n").alias("n_cells"), F.count("*").alias("k"))
    items = rows.agg(F.countDistinct("item").alias("n_items"))
    one = beside(by_pair, marginal, items)
    chance = F.col("squares") / (F.col("n_cells") * F.col("n_cells"))
    corrected = lambda e: F.try_divide(F.col("mean_ao") - e, 1 - e)
    return one.filter("n_items > 0").select(
        "n_items", "mean_ao", "kappa", F.col("kappa").alias("weighted_kappa"), corrected(F.col("mean_ae")).alias("multi_kappa"), corrected(chance).alias("multi_pi"), corrected(1 / F.col("k")).alias("s"),
    )


def krippendorff_alpha(ratings: DataFrame) -> DataFrame:
    """One row: n_items, n_values, alpha (nominal); items with at least two labels, missing ones allowed."""
    tallies = cells(ratings).groupBy("item", "label").agg(F.count("*").alias("n"))
    m = F.sum("n").over(Window.partitionBy("item"))
    pairable = tallies.withColumn("m", m).filter("m > 1")
    observed = pairable.agg(F.sum(F.col("n") * (F.col("m") - F.col("n")) / (F.col("m") - 1)).alias("do"), F.sum("n").alias("n_values"), F.countDistinct("item").alias("n_items"))
    expected = pairable.groupBy("label").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("squares"))
    one = beside(observed, expected).filter("n_values > 0")
    de = (F.col("n_values") * F.col("n_values") - F.col("squares")) / (F.col("n_values") * (F.col("n_values") - 1))
    return one.select("n_items", "n_values", (1 - F.try_divide(F.col("do") / F.col("n_values"), de)).alias("alpha"))


def percent_agreement(ratings: DataFrame) -> DataFrame:
    """One row: mean over complete items of the share of agreeing pairs, and the share of items on which all agree."""
    pairs = coder_pairs(complete_items(ratings))
    per_item = pairs.groupBy("item").agg(F.avg(F.when(F.col("label_a") == F.col("label_b"), 1.0).otherwise(0.0)).alias("share"))
    return per_item.agg(F.count("*").alias("n_items"), F.avg("share").alias("mean_share"), F.avg(F.when(F.col("share") == 1, 1.0).otherwise(0.0)).alias("strict_share"))


def pairwise_prf(ratings: DataFrame) -> DataFrame:
    """(a, b, label, precision, recall, f1) of b's labels against a's on complete items, and with label null the micro mean, which is the share of equal ones."""
    tallies = coder_pairs(complete_items(ratings)).groupBy("a", "b", "label_a", "label_b").agg(F.count("*").alias("n"))
    sides = tallies.select("a", "b", F.explode(F.array(F.struct(F.col("label_a").alias("label"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")), F.struct(F.col("label_b").alias("label"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb")))).alias("x"), F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0).alias("hit"))
    per_label = sides.groupBy("a", "b", "x.label").agg(F.sum("x.na").alias("na"), F.sum("x.nb").alias("nb"), (F.sum("hit") / 2).alias("tp"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    scores = per_label.select("a", "b", "label", zero(F.try_divide("tp", "nb")).alias("precision"), zero(F.try_divide("tp", "na")).alias("recall"), zero(F.try_divide(2 * F.col("tp"), F.col("na") + F.col("nb"))).alias("f1"))
    micro = per_label.groupBy("a", "b").agg((F.sum("tp") / F.sum("na")).alias("x")).select("a", "b", F.lit(None).cast("string").alias("label"), F.col("x").alias("precision"), F.col("x").alias("recall"), F.col("x").alias("f1"))
    return scores.unionByName(micro)


def disagreements(ratings: DataFrame) -> DataFrame:
    """(item, labels) of items with more than one distinct label, labels in order."""
    return cells(ratings).groupBy("item").agg(F.array_sort(F.collect_set("label")).alias("labels")).filter(F.size("labels") > 1)


def rating_matrix(ratings: DataFrame, coders: list[str], missing: str | None = None) -> DataFrame:
    """One row an item, one column a coder; blank cells null or `missing`."""
    wide = cells(ratings).groupBy("item").pivot("coder", coders).agg(F.first("label"))
    return wide.na.fill(missing) if missing is not None else wide
