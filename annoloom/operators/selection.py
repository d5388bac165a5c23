"""Choosing among several annotated copies of a document, and cleaning a corpus of empty, repeated and listed ones.

docs: title, doc_uid, annotator and what a rule orders by; one row a copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import median_like


def without_spare_copies(docs: DataFrame, units: str, is_test: Column, moderator: str) -> DataFrame:
    """Titles with several copies: of those outside the test set the one with most units stays (others' before the moderator's, then the least doc_uid); if only one is outside, it goes.

    Titles with one copy stay, as do all copies in the test set. Null titles are one title.
    """
    own = Window.partitionBy("title")
    spare = ~F.coalesce(is_test, F.lit(False))
    marked = docs.withColumn("_spare", spare).withColumn("_n", F.count("*").over(own)).withColumn("_spares", F.count_if(F.col("_spare")).over(own))
    order = Window.partitionBy("title", "_spare").orderBy(F.desc(F.coalesce(units, F.lit(0))), F.coalesce(F.col("annotator") == moderator, F.lit(False)), "doc_uid")
    placed = marked.withColumn("_place", F.row_number().over(order))
    keep = (F.col("_n") == 1) | ~F.col("_spare") | ((F.col("_spares") > 1) & (F.col("_place") == 1))
    return placed.filter(keep).drop("_spare", "_n", "_spares", "_place")


def most_units(docs: DataFrame, units: str) -> DataFrame:
    """(title, doc_uid): each title's copy with most units, the least doc_uid on ties."""
    return docs.groupBy("title").agg(F.min_by("doc_uid", F.struct(-F.coalesce(units, F.lit(0)), F.col("doc_uid"))).alias("doc_uid"))


def median_units(docs: DataFrame, units: str) -> DataFrame:
    """(title, doc_uid): each title's copy whose number of units is nearest to the mean of its copies."""
    return median_like(docs, ["title"], units, "doc_uid").select("title", "doc_uid")


def best_scored(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """(title, doc_uid): the copy that others' copies agree with best: greatest mean score (scores: doc_uid, score, a row for each comparison), then the least doc_uid; copies without a score last."""
    mean = scores.groupBy("doc_uid").agg(F.avg("score").alias("_s"))
    return docs.join(mean, "doc_uid", "left").groupBy("title").agg(F.min_by("doc_uid", F.struct(-F.coalesce("_s", F.lit(-1.0)), F.col("doc_uid"))).alias("doc_uid"))


METHODS = {"most_units": most_units, "median_units": median_units}


def cleaned(docs: DataFrame, units: str, method: str = "most_units") -> DataFrame:
    """docs without empty copies, one copy a title by the named method; an unknown name is an error."""
    if method not in METHODS:
        raise ValueError(f"no way to choose a copy: {method}; there are {sorted(METHODS)}")
    filled = docs.filter(F.col(units) > 0)
    return filled.join(METHODS[method](filled, units).select("doc_uid"), "doc_uid", "left_semi")


def kept_by_list(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """Titles of one copy stay; of titles with several only copies listed as (title, annotator)."""
    several = docs.groupBy("title").agg(F.count("*").alias("_n"))
    joined = docs.join(several, docs["title"].eqNullSafe(several["title"])).drop(several["title"])
    chosen = listed.select("title", "annotator").distinct().withColumn("_listed", F.lit(True))
    return joined.join(chosen, ["title", "annotator"], "left").filter((F.col("_n") == 1) | F.col("_listed")).drop("_n", "_listed")


def without_records(docs: DataFrame, excluded: DataFrame) -> DataFrame:
    """docs without those that equal a row of excluded in all of its columns; null equals null."""
    e = excluded.distinct().alias("e")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"e.{c}")) for c in excluded.columns]
    return docs.alias("d").join(e, same, "left_anti")


def with_company(docs: DataFrame, companies: DataFrame, title: str = "title", key: str = "symbol") -> DataFrame:
    """docs with the company of their title: the part before the first "_" without its last two characters, in lower case; "Unresolved" for titles that start with a digit, null where there is no such company.

    companies: key and other columns, one row a symbol.
    """
    stem = F.split_part(F.lower(title), F.lit("_"), F.lit(1))
    symbol = F.when(F.col(title).rlike("^[0-9]"), "Unresolved").otherwise(F.nullif(F.left(stem, F.greatest(F.length(stem) - 2, F.lit(0))), F.lit("")))
    known = companies.withColumn("_symbol", F.lower(key)).drop(key)
    return docs.withColumn("symbol", symbol).join(known, F.col("symbol") == F.col("_symbol"), "left").drop("_symbol")
