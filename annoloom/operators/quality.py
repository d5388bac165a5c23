"""Checks of annotations: each gives the rows that break a rule, or counts of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import weighted_ratio


def weakly_realized(events: DataFrame, *ties: DataFrame) -> DataFrame:
    """Events (doc_uid, element_id) that no frame of ties (doc_uid, event_id) names."""
    out = events
    for t in ties:
        out = out.join(t.select("doc_uid", F.col("event_id").alias("element_id")), ["doc_uid", "element_id"], "left_anti")
    return out


def role_stem(role: Column) -> Column:
    """What comes before the first underscore, in lower case without blanks around; null for nothing."""
    return F.nullif(F.trim(F.lower(F.substring_index(role, "_", 1))), F.lit(""))


def role_violations(links: DataFrame, roles: DataFrame, free: list[str]) -> DataFrame:
    """Links whose layer has no such role in the typology and whose stem is not in `free`; a null role is one, too. roles: layer, stem."""
    named = links.withColumn("stem", role_stem(F.col("link_role")))
    bad = named.filter(~F.coalesce(F.col("stem").isin(free), F.lit(False)))
    return bad.join(roles.select("layer", "stem").distinct(), ["layer", "stem"], "left_anti")


def typed_role_violations(children: DataFrame, events: DataFrame, typology: DataFrame) -> DataFrame:
    """Participants and fillers of typed events whose role their type (and subtype, where the typology marks it) doesn't have: (record_id, doc_uid, event_no, layer, link_id, role, problem)."""
    kinds = typology.select("maintype_name", "subtype_name", F.explode(F.array(F.struct(F.lit("participant").alias("layer"), F.col("participant").alias("roles")), F.struct(F.lit("filler").alias("layer"), F.col("filler").alias("roles")))).alias("x"))
    allowed = kinds.select("maintype_name", "subtype_name", "x.layer", F.explode("x.roles").alias("r"))
    on_type = allowed.filter("r.on_type").select(F.col("maintype_name").alias("event_type"), "layer", role_stem(F.col("r.name")).alias("stem")).distinct()
    on_sub = allowed.filter("r.on_subtype and subtype_name is not null").select(F.col("maintype_name").alias("event_type"), F.col("subtype_name").alias("event_subtype"), "layer", role_stem(F.col("r.name")).alias("stem")).distinct()
    typed = children.filter(F.col("layer").isin("participant", "filler")).join(events.select("record_id", "doc_uid", "event_no", "event_type", "event_subtype"), ["record_id", "doc_uid", "event_no"]).withColumn("stem", role_stem(F.col("role")))
    main = typed.filter("event_subtype is null").join(on_type, ["event_type", "layer", "stem"], "left_anti").withColumn("problem", F.lit("not on type"))
    sub = typed.filter("event_subtype is not null").join(on_sub, ["event_type", "event_subtype", "layer", "stem"], "left_anti").withColumn("problem", F.lit("not on subtype"))
    return main.unionByName(sub).select("record_id", "doc_uid", "event_no", "layer", "link_id", "role", "problem")


def low_density(tokens: DataFrame, units: DataFrame, most: float = 0.75) -> DataFrame:
    """Documents with no more than `most` units a sentence: (doc_id, n_sentences, n_units, density)."""
    sentences = tokens.groupBy("doc_id").agg((F.max("sent_idx") + 1).cast("long").alias("n_sentences"))
    n = units.groupBy("doc_id").agg(F.count("*").alias("n_units"))
    joined = sentences.join(n, "doc_id", "left").withColumn("n_units", F.coalesce("n_units", F.lit(0)))
    return joined.withColumn("density", F.col("n_units") / F.col("n_sentences")).filter(F.col("density") <= most)


def cue_mismatches(units: DataFrame, text: str, label: str, cues: dict[str, list[str]]) -> DataFrame:
    """Units whose text holds a cue of another label than theirs (a null label is another one): a row for each such label as cue_label."""
    low = F.lower(text)
    held = F.array(*(F.when(F.exists(F.array(*(F.lit(w) for w in words)), lambda w: low.contains(w)), F.lit(lb)) for lb, words in cues.items()))
    named = units.withColumn("cue_label", F.explode(F.filter(held, lambda x: x.isNotNull())))
    return named.filter(~F.col("cue_label").eqNullSafe(F.col(label)))


def keywords_missed(tokens: DataFrame, covered: DataFrame, keywords: dict[str, list[str]], least: int = 95) -> DataFrame:
    """(doc_id, label, n_missed): tokens that are like a label's keyword (weighted ratio of at least `least`; letters of any script, any case) and lie in no unit of the label. covered: doc_id, label, tok_idx.

    Each distinct token is compared once with every keyword: by edit distance, which bounds the ratio of single words, and
    only what may reach `least` by the ratio itself. What is like a keyword, a few spellings of each, is broadcast.
    """
    low = F.lower(F.regexp_replace("tok", r"[^\p{L}]", ""))
    pairs = F.explode(F.array(*(F.struct(F.lit(lb).alias("label"), F.lit(w.lower()).alias("keyword")) for lb, words in keywords.items() for w in words))).alias("k")
    may = F.col("word") != "", (100.5 - least) * (F.length("word") + F.length("k.keyword")) >= 100 * F.levenshtein("word", F.col("k.keyword"))
    near = tokens.select(low.alias("word")).distinct().select("word", pairs).filter(may[0] & may[1])
    like = near.filter(weighted_ratio(F.col("word"), F.col("k.keyword")) >= least).select("word", "k.label").distinct()
    each = tokens.select("doc_id", "tok_idx", low.alias("word")).join(F.broadcast(like), "word").select("doc_id", "tok_idx", "label")
    return each.join(covered.select("doc_id", "label", "tok_idx"), ["doc_id", "label", "tok_idx"], "left_anti").groupBy("doc_id", "label").agg(F.count("*").alias("n_missed"))


def issue_list(issues: DataFrame, unit: list[str]) -> DataFrame:
    """(unit, issues, n_issues): the ordered distinct issues of each unit. issues: unit columns, issue."""
    return issues.groupBy(*unit).agg(F.array_sort(F.collect_set("issue")).alias("issues")).withColumn("n_issues", F.size("issues").cast("long"))


def crossing_pairs(units: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, n_kept, n_removed): of all pairs of a unit and a target of a document those in one sentence and those across, counted by products, not made. What has no sentence goes with nothing."""
    per = lambda df, name, *by: df.groupBy("doc_id", *by).agg(F.count("*").alias(name))
    inside = per(units.filter("sent_idx is not null"), "a", "sent_idx").join(per(targets, "b", "sent_idx"), ["doc_id", "sent_idx"]).groupBy("doc_id").agg(F.sum(F.col("a") * F.col("b")).alias("n_kept"))
    total = per(units, "a").join(per(targets, "b"), "doc_id").join(inside, "doc_id", "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
    return total.select("doc_id", "n_kept", (F.col("a") * F.col("b") - F.col("n_kept")).alias("n_removed"))


def error_in_reference(errors: DataFrame, references: DataFrame, on: str = "sent_id") -> DataFrame:
    """Range join of predicted positions and reference spans of one sentence: ref first <= pred_ix <= ref last, by exploded positions."""
    places = references.filter("first <= last").withColumn("pred_ix", F.explode(F.sequence("first", "last")))
    return errors.join(places, [on, "pred_ix"])


def length_counts(spans: DataFrame, by: list[str]) -> DataFrame:
    """Units of one token and of more, in each group."""
    n = F.col("last") - F.col("first") + 1
    return spans.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(n > 1).alias("n_multiword"), F.avg(n).alias("mean_tokens"))


def repeated_values(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, order, n) of values that occur more than once: a row for each of their places, with their number. Null is no value."""
    n = F.count("*").over(Window.partitionBy(value))
    return df.filter(F.col(value).isNotNull()).withColumn("n", n).filter("n > 1").select(value, order, "n")
