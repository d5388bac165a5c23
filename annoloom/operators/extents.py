"""Extents: the tokens of a unit together with those of the units that hang on it, and what contains what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extent_tokens(units: DataFrame, parts: DataFrame, tokens: DataFrame, layers: list[str], same_sentence: bool = True) -> DataFrame:
    """(doc_uid, element_id, tok_idx, tok): the distinct tokens of each unit and of its parts of the given layers.

    units: doc_uid, element_id, first, last; parts: doc_uid, element_id (the unit), layer, first, last; tokens: doc_uid,
    tok_idx, sent_idx, tok. same_sentence keeps only such tokens of parts as stand in the sentence of the unit's first
    token (events; sentiment expressions keep all). Units without tokens have no row; null or reversed spans have none.
    """
    span = lambda df: df.filter("first <= last").select("doc_uid", "element_id", F.explode(F.sequence("first", "last")).alias("tok_idx"))
    core = units.filter("first <= last").select("doc_uid", "element_id", F.col("first").alias("tok_idx"))
    home = core.join(tokens.select("doc_uid", "tok_idx", F.col("sent_idx").alias("home")), ["doc_uid", "tok_idx"]).select("doc_uid", "element_id", "home")
    words = tokens.select("doc_uid", "tok_idx", "sent_idx", "tok")
    own = span(units).join(words, ["doc_uid", "tok_idx"])
    more = span(parts.filter(F.col("layer").isin(layers)).join(units.select("doc_uid", "element_id"), ["doc_uid", "element_id"], "left_semi")).distinct().join(words, ["doc_uid", "tok_idx"])
    if same_sentence:
        more = more.join(home, ["doc_uid", "element_id"]).filter(F.col("sent_idx").eqNullSafe(F.col("home"))).drop("home")
    return own.unionByName(more).select("doc_uid", "element_id", "tok_idx", "tok").distinct()


def extent_text(extent: DataFrame, in_order: bool = True) -> DataFrame:
    """(doc_uid, element_id, n_tokens, tok_ids, text) of extent_tokens, words in the order of the text."""
    per = extent.groupBy("doc_uid", "element_id").agg(F.array_sort(F.collect_list(F.struct("tok_idx", "tok"))).alias("t"))
    ids = F.transform("t", lambda x: x["tok_idx"])
    return per.select("doc_uid", "element_id", F.size("t").alias("n_tokens"), ids.alias("tok_ids"), F.array_join(F.transform("t", lambda x: x["tok"]), " ").alias("text"))


def token_keys(doc: Column, tok_ids: Column) -> Column:
    """Token ids that are unique in a corpus: the document's id before each."""
    return F.transform(tok_ids, lambda i: F.concat_ws("_", doc, i.cast("string")))


def containers(members: DataFrame, owner: str = "event_id") -> DataFrame:
    """(doc_uid, element_id, owners, n_owners): the bridge read the other way, which events (or sentiment expressions) a unit is in. members: doc_uid, element_id, owner."""
    per = members.filter(F.col(owner).isNotNull()).select("doc_uid", "element_id", F.col(owner).alias("o")).distinct().groupBy("doc_uid", "element_id").agg(F.array_sort(F.collect_list("o")).alias("owners"))
    return per.withColumn("n_owners", F.size("owners"))


def place_in_sentence(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """tokens with sent_tok_idx, the place from 0 in its sentence."""
    return tokens.withColumn("sent_tok_idx", F.row_number().over(Window.partitionBy(doc, "sent_idx").orderBy("tok_idx")) - 1)


def either(columns: list[str], label: str) -> Column:
    """One column out of several: label where any of them is set, else null."""
    return F.when(F.coalesce(*(F.col(c) for c in columns)).isNotNull(), label)


def token_ratings(tokens: DataFrame, units: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """tokens (doc_uid, tok_idx) with a column for each kind: 1 where a unit of one of its layers covers the token, else -1; and the labels of the covering units, joined by "|", as `labels` ("-1" for none).

    units: doc_uid, layer, first, last, label.
    """
    marks = units.filter("first <= last").select("doc_uid", "layer", "label", F.explode(F.sequence("first", "last")).alias("tok_idx"))
    hit = {k: F.max(F.when(F.col("layer").isin(layers), 1).otherwise(-1)).alias(k) for k, layers in kinds.items()}
    per = marks.groupBy("doc_uid", "tok_idx").agg(*hit.values(), F.array_join(F.array_sort(F.collect_set("label")), "|").alias("labels"))
    joined = tokens.select("doc_uid", "tok_idx").join(per, ["doc_uid", "tok_idx"], "left")
    none = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-1"))
    return joined.select("doc_uid", "tok_idx", *(F.coalesce(k, F.lit(-1)).alias(k) for k in kinds), none("labels").alias("labels"))
