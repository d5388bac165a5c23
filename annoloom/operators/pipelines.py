"""Preparing units and their targets for export: targets by role, by referent, in the sentence, without pronouns.

units: doc_uid, unit_id, sent_idx; targets: doc_uid, unit_id, target_id, first, last, sent_idx. A sentence of null is none:
what crosses sentences is in no sentence with anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, TARGET = ["doc_uid", "unit_id"], ["doc_uid", "unit_id", "target_id", "first", "last", "sent_idx"]


def target_roles(arguments: DataFrame, typology: DataFrame) -> DataFrame:
    """Arguments whose role is one of a target for their unit's type. arguments: type (full name), role; typology: full_name, participant, filler."""
    roles = typology.select(F.col("full_name").alias("type"), F.explode(F.concat(F.coalesce("participant", F.array()), F.coalesce("filler", F.array()))).alias("r")).filter("r.is_target").select("type", F.col("r.name").alias("role")).distinct()
    return arguments.join(roles, ["type", "role"], "left_semi")


def _with_referents(targets: DataFrame, referents: DataFrame, spots: DataFrame) -> DataFrame:
    """Each target with a row for each of its referents: new_id, its place, has_referent."""
    pairs = referents.select("doc_uid", F.col("element_id").alias("target_id"), F.col("referent_id").alias("new_id")).filter("new_id is not null and target_id is not null").distinct()
    at = spots.select("doc_uid", F.col("element_id").alias("new_id"), F.col("first").alias("new_first"), F.col("last").alias("new_last"), F.col("sent_idx").alias("new_sent"))
    return targets.join(pairs.join(at, ["doc_uid", "new_id"]), ["doc_uid", "target_id"], "left")


def replaced_targets(targets: DataFrame, referents: DataFrame, spots: DataFrame, same_sentence: bool = False) -> DataFrame:
    """Targets as their referents (doc_uid, element_id, referent_id; spots has their places); those without a referent stay.

    With same_sentence only referents in the target's sentence count; a target all of whose referents stand elsewhere
    disappears. Referents without a place are none. Equal results are one.
    """
    all_ = _with_referents(targets, referents, spots)
    keep = F.col("new_id").isNull() | (F.col("new_sent").eqNullSafe(F.col("sent_idx")) if same_sentence else F.lit(True))
    moved = lambda new, old: F.when(F.col("new_id").isNull(), F.col(old)).otherwise(F.col(new)).alias(old)
    return all_.filter(keep).select(*UNIT, moved("new_id", "target_id"), moved("new_first", "first"), moved("new_last", "last"), moved("new_sent", "sent_idx")).distinct()


def extended_targets(targets: DataFrame, referents: DataFrame, spots: DataFrame, most: int, same_sentence: bool = True) -> DataFrame:
    """All targets and those of their referents whose length plus distance is less than `most` tokens (with same_sentence in the target's sentence)."""
    all_ = _with_referents(targets, referents, spots).filter("new_id is not null")
    gap = F.when(F.col("last") < F.col("new_first"), F.col("new_first") - F.col("last")).when(F.col("new_last") < F.col("first"), F.col("first") - F.col("new_last")).otherwise(0)
    near = all_.filter(F.col("new_last") - F.col("new_first") + 1 + gap < most)
    if same_sentence:
        near = near.filter(F.col("new_sent").eqNullSafe(F.col("sent_idx")))
    added = near.select(*UNIT, F.col("new_id").alias("target_id"), F.col("new_first").alias("first"), F.col("new_last").alias("last"), F.col("new_sent").alias("sent_idx"))
    return targets.select(*TARGET).unionByName(added).distinct()


def targets_in_sentence(units: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets in the sentence of their unit."""
    return targets.join(units.select(*UNIT, "sent_idx"), [*UNIT, "sent_idx"], "left_semi").select(*TARGET)


def without_pronominal(targets: DataFrame, pronominal: DataFrame) -> DataFrame:
    """Targets but those in pronominal (doc_uid, element_id)."""
    return targets.join(pronominal.select("doc_uid", F.col("element_id").alias("target_id")), ["doc_uid", "target_id"], "left_anti").select(*TARGET)


def without_units(units: DataFrame, *frames: DataFrame) -> DataFrame:
    """Units named in none of the frames (doc_uid, unit_id)."""
    out = units
    for f in frames:
        out = out.join(f.select(*UNIT), UNIT, "left_anti")
    return out


def pronominal_spans(spans: DataFrame, tokens: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(doc_uid, element_id) of spans all of whose tokens have one of the tags. tokens: doc_uid, tok_idx, tag."""
    each = spans.filter("first <= last").select("doc_uid", "element_id", F.explode(F.sequence("first", "last")).alias("tok_idx")).join(tokens.select("doc_uid", "tok_idx", "tag"), ["doc_uid", "tok_idx"])
    return each.groupBy("doc_uid", "element_id").agg(F.bool_and(F.coalesce(F.col("tag").isin(*tags), F.lit(False))).alias("all")).filter("all").select("doc_uid", "element_id")


def prepare(
    units: DataFrame, targets: DataFrame, referents: DataFrame | None = None, spots: DataFrame | None = None, pronominal: DataFrame | None = None, cross_sentence: bool = False, extend: int | None = None, keep_bare_units: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The chain in its order: referents (put in the targets' place, or beside them with extend=tokens), sentences, pronouns.

    Steps whose frame is None, and the sentences' with cross_sentence, are left out. Units that lose all their targets go,
    too, unless keep_bare_units. (units, targets)
    """
    out = targets.select(*TARGET)
    if referents is not None and spots is not None:
        out = replaced_targets(out, referents, spots, not cross_sentence) if extend is None else extended_targets(out, referents, spots, extend, not cross_sentence)
    if not cross_sentence:
        out = targets_in_sentence(units, out)
    if pronominal is not None:
        out = without_pronominal(out, pronominal)
    return units if keep_bare_units else units.join(out.select(*UNIT), UNIT, "left_semi"), out


def loss(before: DataFrame, after: DataFrame, step: str) -> DataFrame:
    """One row (step, n_before, n_after, n_removed, pct): how much a step took away."""
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("_k", F.lit(1))
    n = one(before, "n_before").join(one(after, "n_after"), "_k")  # one row each
    gone = F.col("n_before") - F.col("n_after")
    return n.select(F.lit(step).alias("step"), "n_before", "n_after", gone.alias("n_removed"), F.round(100.0 * F.try_divide(gone, F.col("n_before")), 1).alias("pct"))
