"""Annotation elements and what ties them: current versions, links, referents, containment, coordination."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current(df: DataFrame, keys: list[str], columns: list[str], time: str = "ingested_at", deleted: str | None = "deleted_at") -> DataFrame:
    """The latest delivery of each key, without those whose latest delivery is deleted; of several latest ones that with the greatest columns.

    A null time is earlier than any other. An aggregation that combines before its shuffle, not a sort of each key's rows.
    """
    gone = F.col(deleted).isNotNull() if deleted else F.lit(False)
    last = df.groupBy(*keys).agg(F.max(F.struct(F.col(time), gone.alias("gone"), *columns)).alias("last"))
    return last.filter("not last.gone").select(*keys, *(F.col("last")[c].alias(c) for c in columns))


def linked(elements: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each link of an element (doc_uid, target_id = element_id); elements without a link are left out."""
    return elements.join(links.withColumnRenamed("target_id", "element_id"), ["doc_uid", "element_id"])


def first_link(elements: DataFrame, links: DataFrame) -> DataFrame:
    """Every element with its least link_id, or null."""
    first = links.groupBy("doc_uid", F.col("target_id").alias("element_id")).agg(F.min("link_id").alias("link_id"))
    return elements.join(first, ["doc_uid", "element_id"], "left")


def referents_of(elements: DataFrame, relations: DataFrame) -> DataFrame:
    """Every element with the ordered distinct referents of its id, null without any; ids of 0 name nothing."""
    pairs = relations.filter("pronom_id <> 0 and referent_id <> 0").groupBy("doc_uid", F.col("pronom_id").alias("element_id")).agg(F.array_sort(F.collect_set("referent_id")).alias("referents"))
    return elements.join(pairs, ["doc_uid", "element_id"], "left")


def by_id_list(owners: DataFrame, id_list: str, members: DataFrame, scope: list[str], member_id: str) -> DataFrame:
    """Owners joined to the members named in a blank-separated list of ids; unknown ids and empty lists give no row."""
    ids = owners.withColumn(member_id, F.explode(F.filter(F.split(F.trim(id_list), r"\s+"), lambda x: x != ""))).withColumn(member_id, F.col(member_id).try_cast("long"))
    return ids.join(members, [*scope, member_id])


def replace_by_referents(targets: DataFrame, relations: DataFrame, elements: DataFrame) -> DataFrame:
    """Each target (doc_uid, element_id, ...) as a row for each of its known referents (new_id, begin_pos, end_pos), itself where it names none; where it names only unknown ones it disappears."""
    pairs = relations.filter("pronom_id <> 0 and referent_id <> 0").select("doc_uid", F.col("pronom_id").alias("element_id"), F.col("referent_id").alias("new_id")).distinct()
    spots = elements.select("doc_uid", F.col("element_id").alias("new_id"), F.col("begin_pos").alias("new_begin"), F.col("end_pos").alias("new_end"))
    named = targets.join(pairs, ["doc_uid", "element_id"], "left").join(spots, ["doc_uid", "new_id"], "left")
    kept = named.filter(F.col("new_id").isNull() | F.col("new_begin").isNotNull())
    return kept.select("doc_uid", "element_id", F.coalesce("new_id", "element_id").alias("new_id"), F.coalesce("new_begin", "begin_pos").alias("begin_pos"), F.coalesce("new_end", "end_pos").alias("end_pos"))


def contained(inner: DataFrame, outer: DataFrame, keys: list[str], bucket: int = 64) -> DataFrame:
    """Pairs with outer.begin_pos <= inner.begin_pos and inner.end_pos <= outer.end_pos, by an equi-join on buckets of `bucket` positions.

    The inner span sits in the bucket of its start; the outer one in all buckets it covers. inner: inner_id, outer: outer_id.
    """
    i = inner.filter("begin_pos <= end_pos").select(*keys, "inner_id", "begin_pos", "end_pos", F.floor(F.col("begin_pos") / bucket).alias("b"))
    o = outer.filter("begin_pos <= end_pos").select(*keys, "outer_id", F.col("begin_pos").alias("outer_begin"), F.col("end_pos").alias("outer_end"))
    o = o.withColumn("b", F.explode(F.sequence(F.floor(F.col("outer_begin") / bucket), F.floor(F.col("outer_end") / bucket))))
    return i.join(o, [*keys, "b"]).filter("outer_begin <= begin_pos and end_pos <= outer_end").drop("b")


def coordination_groups(events: DataFrame) -> DataFrame:
    """Events of one document with the very same span: (doc_uid, element_id, coord_group), only groups of two and more, numbered by span."""
    size = F.count("*").over(Window.partitionBy("doc_uid", "begin_pos", "end_pos"))
    number = F.dense_rank().over(Window.partitionBy("doc_uid").orderBy("begin_pos", "end_pos"))
    return events.filter("begin_pos is not null and end_pos is not null").withColumn("n", size).filter("n > 1").select("doc_uid", "element_id", number.alias("coord_group"))
