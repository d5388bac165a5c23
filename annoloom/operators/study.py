"""Agreement studies: which documents several annotators share, and every annotator scored against every other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import matching, scoring


def titles_by_annotator(docs: DataFrame) -> DataFrame:
    """(annotator, n_titles, n_missing): how many of the study's titles each annotator has, and lacks. docs: annotator, title."""
    have = docs.filter("annotator is not null and title is not null").select("annotator", "title").distinct()
    all_ = have.agg(F.count_distinct("title").alias("n_all")).withColumn("_k", F.lit(1))  # one row
    per = have.groupBy("annotator").agg(F.count("*").alias("n_titles")).withColumn("_k", F.lit(1))
    return per.join(all_, "_k").select("annotator", "n_titles", (F.col("n_all") - F.col("n_titles")).alias("n_missing"))


def same_titles(docs: DataFrame) -> bool:
    """Whether all annotators have the same titles, as a study of all against all needs."""
    return titles_by_annotator(docs).filter("n_missing > 0").isEmpty()


def ordered_pairs(docs: DataFrame) -> DataFrame:
    """(title, ref_annotator, annotator): every two different annotators of a title, both ways. An equi-join on the title."""
    have = docs.filter("annotator is not null and title is not null").select("annotator", "title").distinct()
    return have.withColumnRenamed("annotator", "ref_annotator").join(have, "title").filter("ref_annotator <> annotator").select("title", "ref_annotator", "annotator")


def by_annotator(units: DataFrame, condition: Column | None = None) -> DataFrame:
    """(annotator, n_units, n_docs) of the units, where given only of those that meet a condition."""
    own = units if condition is None else units.filter(condition)
    return own.groupBy("annotator").agg(F.count("*").alias("n_units"), F.count_distinct("doc_id").alias("n_docs"))


def matches_of(spans: DataFrame, annotators: list[int | str], **strategies: str) -> DataFrame:
    """(ref_annotator, doc_id, annotator, gold_id, sys_id, dice): every annotator's spans as gold, matched with all others'. spans: doc_id, annotator, span_id, first, last. annotators: a given list, a union for each."""
    return reduce(DataFrame.unionByName, (matching.match(*sides(spans, a), **strategies).withColumn("ref_annotator", F.lit(a)) for a in annotators))


def sides(spans: DataFrame, gold: int | str, systems: list[int | str] | None = None) -> tuple[DataFrame, DataFrame]:
    """One annotator's spans as gold and the others' (or the named ones') as systems."""
    others = F.col("annotator") != gold if systems is None else F.col("annotator").isin(systems)
    return spans.filter(F.col("annotator") == gold).drop("annotator").withColumnRenamed("span_id", "gold_id"), spans.filter(others).withColumnRenamed("span_id", "sys_id")


def match_counts(spans: DataFrame, matches: DataFrame) -> DataFrame:
    """(ref_annotator, annotator, n_ref, n_matched, pct): of each annotator's spans those that found a match with each other one, in documents both have."""
    have = spans.select("doc_id", "annotator").distinct()
    ref = spans.select("doc_id", F.col("annotator").alias("ref_annotator"), F.col("span_id").alias("gold_id"))
    shared = ref.groupBy("doc_id", "ref_annotator").agg(F.count("*").alias("n")).join(have, "doc_id").filter("ref_annotator <> annotator")
    total = shared.groupBy("ref_annotator", "annotator").agg(F.sum("n").alias("n_ref"))
    hit = matches.select("ref_annotator", "annotator", "doc_id", "gold_id").distinct().groupBy("ref_annotator", "annotator").agg(F.count("*").alias("n_matched"))
    joined = total.join(hit, ["ref_annotator", "annotator"], "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
    return joined.withColumn("pct", F.round(100.0 * F.col("n_matched") / F.col("n_ref"), 1))


def document_scores(spans: DataFrame, ref: int | str, other: int | str, attributes: list[str]) -> DataFrame:
    """Nugget scores of one annotator's documents against another's, a row for each document."""
    gold, system = sides(spans, ref, [other])
    return scoring.prf(scoring.nugget_sums(gold, system, matching.match(gold, system), attributes), attributes)


def match_report(gold: DataFrame, system: DataFrame, matches: DataFrame) -> DataFrame:
    """(annotator, n_gold, n_gold_mapped, n_system, n_system_mapped): what the matches left out on either side, documents of both."""
    docs = system.select("doc_id", "annotator").distinct()
    golds = gold.select("doc_id", "gold_id").join(docs, "doc_id").groupBy("annotator").agg(F.count("*").alias("n_gold"))
    systems = system.groupBy("annotator").agg(F.count("*").alias("n_system"))
    used = matches.groupBy("annotator").agg(F.count_distinct("doc_id", "gold_id").alias("n_gold_mapped"), F.count_distinct("doc_id", "sys_id").alias("n_system_mapped"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return golds.join(systems, "annotator", "full").join(used, "annotator", "left").select("annotator", zero("n_gold"), zero("n_gold_mapped"), zero("n_system"), zero("n_system_mapped"))


def windowed_distance(a: Column, b: Column, same: float = 0.0, partly: float = 0.5, other: float = 1.0) -> Column:
    """A distance of labels that are sets written with "|": 0 for the same, `partly` where they share one, else 1; null where either is null."""
    x, y = F.array_sort(F.split(a, r"\|")), F.array_sort(F.split(b, r"\|"))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(x == y, same).when(F.arrays_overlap(x, y), partly).otherwise(other)


def mean_distance(ratings: DataFrame, distance=windowed_distance) -> DataFrame:
    """(coder_a, coder_b, n_items, distance): the mean distance of each two coders' labels of an item, by any Column function. ratings: coder, item, label."""
    own = ratings.filter("label is not null and coder is not null").dropDuplicates(["coder", "item"])
    pairs = own.select("item", F.col("coder").alias("coder_a"), F.col("label").alias("a")).join(own.select("item", F.col("coder").alias("coder_b"), F.col("label").alias("b")), "item").filter("coder_a < coder_b")
    return pairs.groupBy("coder_a", "coder_b").agg(F.count("*").alias("n_items"), F.avg(distance(F.col("a"), F.col("b"))).alias("distance"))


def mean_confusion(confusion: DataFrame) -> DataFrame:
    """(gold_label, sys_label, mean_share): row shares of confusion matrices, averaged over annotators, absent cells as 0."""
    n = confusion.select("annotator").distinct().agg(F.count("*").alias("k")).withColumn("_k", F.lit(1))  # one row
    total = confusion.groupBy("annotator", "gold_label").agg(F.sum("n").alias("t"))
    share = confusion.join(total, ["annotator", "gold_label"]).groupBy("gold_label", "sys_label").agg(F.sum(F.col("n") / F.col("t")).alias("s")).withColumn("_k", F.lit(1))
    return share.join(n, "_k").select("gold_label", "sys_label", (F.col("s") / F.col("k")).alias("mean_share"))


def ranked(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group in a total order: a top-k report."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")
