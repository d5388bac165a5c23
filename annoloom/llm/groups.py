"""Pairwise matches to groups, by the core's large-star and small-star edge rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import star_components


def mention_groups(relations: DataFrame, scope: str = "doc_uid", a: str = "pronom_id", b: str = "referent_id") -> DataFrame:
    """(scope, element_id, group_id) for every id in a or b within its scope; null and 0 name nothing, an id without a partner is its own group, rows of a null scope give none."""
    pairs = relations.filter(F.col(scope).isNotNull()).select(scope, F.when(F.col(a) != 0, F.col(a)).alias("a"), F.when(F.col(b) != 0, F.col(b)).alias("b"))
    groups = star_components(pairs, "a", "b", [scope])
    alone = pairs.select(scope, F.explode(F.array("a", "b")).alias("element_id")).filter("element_id is not null")
    both = groups.select(scope, F.col("node").alias("element_id"), F.col("group").alias("group_id")).unionByName(alone.select(scope, "element_id", F.col("element_id").alias("group_id")))
    return both.groupBy(scope, "element_id").agg(F.min("group_id").alias("group_id"))
