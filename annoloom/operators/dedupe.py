"""One copy of each document, duplicates, differences and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_best(df: DataFrame, by: list[str], best: list[Column]) -> DataFrame:
    """The first row of each group in the order of `best`, which has to be total; an aggregation-like window of one row a group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).filter("_n = 1").drop("_n")


def repeated(df: DataFrame, by: list[str]) -> DataFrame:
    """All rows whose key occurs more than once, with n."""
    return df.withColumn("n", F.count("*").over(Window.partitionBy(*by))).filter("n > 1")


def drop_duplicates_first(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """The row of least `order` for each key; nulls are one key."""
    return df.groupBy(*by).agg(F.min(F.struct(order, *columns)).alias("x")).select(*by, "x.*")


def title_key(title: Column, most: int | None = None) -> Column:
    """Letters and digits of a title in lower case, all of them or the first `most`: titles that were cut somewhere meet with most=32."""
    key = F.regexp_replace(F.lower(title), "[^a-z0-9]", "")
    return key if most is None else F.substring(key, 1, most)


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): distinct keys that only one side has; null is a key."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.subtract(right).withColumn("side", F.lit("left")).unionByName(right.subtract(left).withColumn("side", F.lit("right")))


def one_per_group(df: DataFrame, group: str, key: str) -> DataFrame:
    """df with split: 'dev' for the row of each group whose md5 of the key is least, else 'train'; the same on every run."""
    first = df.groupBy(group).agg(F.min_by(key, F.struct(F.md5(F.col(key).cast("string")), F.col(key))).alias("_dev"))
    joined = df.join(first, df[group].eqNullSafe(first[group])).drop(first[group])
    return joined.withColumn("split", F.when(F.col(key) == F.col("_dev"), "dev").otherwise("train")).drop("_dev")


def fixed_split(df: DataFrame, key: str, splits: dict[str, list]) -> DataFrame:
    """df with split by fixed lists of ids; ids in no list are left out, an id in two lists goes to the first."""
    expr = None
    for name, ids in splits.items():
        expr = F.when(F.col(key).isin(ids), name) if expr is None else expr.when(F.col(key).isin(ids), name)
    return df.withColumn("split", expr if expr is not None else F.lit(None)).filter("split is not null")


def gold_or_silver(df: DataFrame, title: str, annotator: str, gold: list[str], moderator: str) -> DataFrame:
    """Of gold titles only the moderator's copy, as test; of all other titles every copy, as dev."""
    is_gold = F.col(title).isin(gold)
    return df.withColumn("split", F.when(is_gold, F.when(F.col(annotator) == moderator, "test")).otherwise("dev")).filter("split is not null")
