"""More checks, pickers and counters over units, their types, roles and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Type names that were changed later.
RENAMED_TYPES = {"CapitalReturns": "Dividend", "FinancialResult": "FinancialReport"}


def clean_types(units: DataFrame, main: str, sub: str, other: str = "Other") -> DataFrame:
    """units with a type, changed type names as they are now, a null subtype as `other`."""
    names = F.create_map(*(F.lit(x) for kv in RENAMED_TYPES.items() for x in kv))
    return units.filter(F.col(main).isNotNull()).withColumns({main: F.coalesce(F.try_element_at(names, F.col(main)), F.col(main)), sub: F.coalesce(sub, F.lit(other))})


def with_role_around(events: DataFrame, roles: DataFrame, components: DataFrame, role: Column) -> DataFrame:
    """events (doc_uid, element_id) with has_role: whether they, or an event they are tied to, have an argument that meets `role`.

    roles: doc_uid, element_id and what `role` reads; components: doc_uid, node, component; an event in none is alone.
    """
    own = lambda df: df.join(components.select("doc_uid", F.col("node").alias("element_id"), "component"), ["doc_uid", "element_id"], "left").withColumn("component", F.coalesce("component", "element_id"))
    hit = own(roles.filter(role).select("doc_uid", "element_id").distinct()).select("doc_uid", "component").distinct().withColumn("has_role", F.lit(True))
    return own(events).join(hit, ["doc_uid", "component"], "left").select("doc_uid", "element_id", F.coalesce("has_role", F.lit(False)).alias("has_role"))


def unfinished(units: DataFrame, targets: DataFrame, label: str) -> DataFrame:
    """(doc_uid, element_id, no_label, no_target) of units without a label or without a target (doc_uid, element_id)."""
    has = targets.select("doc_uid", "element_id").distinct().withColumn("_t", F.lit(True))
    marked = units.join(has, ["doc_uid", "element_id"], "left").select("doc_uid", "element_id", F.col(label).isNull().alias("no_label"), F.col("_t").isNull().alias("no_target"))
    return marked.filter("no_label or no_target")


def sparse_documents(sentences: DataFrame, units: DataFrame, most: float = 5.0, long: int = 50) -> DataFrame:
    """(doc_id, n_sentences, n_units, sparse, long): documents with more than `most` sentences a unit (or no unit) or more than `long` sentences. sentences: doc_id, sent_idx; units: doc_id."""
    s = sentences.groupBy("doc_id").agg(F.count_distinct("sent_idx").alias("n_sentences"))
    joined = s.join(units.groupBy("doc_id").agg(F.count("*").alias("n_units")), "doc_id", "left").withColumn("n_units", F.coalesce("n_units", F.lit(0)))
    sparse = F.coalesce(F.try_divide("n_sentences", "n_units") > most, F.lit(True))
    return joined.withColumns({"sparse": sparse, "long": F.col("n_sentences") > long}).filter("sparse or long")


def picked_sentences(units: DataFrame, tokens: DataFrame, label: str, least_labels: int = 3, most_tokens: int = 40) -> DataFrame:
    """(doc_id, sent_idx, n_units, n_labels, n_tokens) of short sentences whose units have many different labels: examples for print."""
    per = units.filter("sent_idx is not null").groupBy("doc_id", "sent_idx").agg(F.count("*").alias("n_units"), F.count_distinct(label).alias("n_labels")).filter(F.col("n_labels") >= least_labels)
    size = tokens.groupBy("doc_id", "sent_idx").agg(F.count("*").alias("n_tokens"))
    return per.join(size, ["doc_id", "sent_idx"]).filter(F.col("n_tokens") <= most_tokens)


def not_empty(sentences: DataFrame, lists: str) -> DataFrame:
    """Rows whose array has anything in it."""
    return sentences.filter(F.size(F.coalesce(F.col(lists), F.array())) > 0)


def triple_stats(tokens: DataFrame, triples: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: sentences, sentences with triples, triples, B tags, and for each sentiment its number and share in percent. triples: doc_id, sent_idx, sentiment; tags: tag."""
    one = lambda df: df.withColumn("_k", F.lit(1))
    s = one(tokens.select("doc_id", "sent_idx").distinct().agg(F.count("*").alias("n_sentences")))
    n = F.count(F.lit(1))
    t = triples.agg(F.count_distinct("doc_id", "sent_idx").alias("n_with_triples"), n.alias("n_triples"), *(F.count_if(F.col("sentiment") == x).alias(f"n_{x}") for x in ("positive", "neutral", "negative")))
    b = one(tags.agg(F.count_if(F.col("tag") == "B").alias("n_b_tags")))
    joined = s.join(one(t), "_k").join(b, "_k").drop("_k")  # one row each
    return joined.withColumns({f"pct_{x}": F.round(100.0 * F.try_divide(f"n_{x}", "n_triples"), 1) for x in ("positive", "neutral", "negative")})


def counters(df: DataFrame, by: str, key: str, all_: str = "all") -> DataFrame:
    """(by, key, n): counts of each key in each group, and under `all_` their sums over all groups."""
    rolled = df.filter(F.col(by).isNotNull()).cube(by, key).agg(F.count("*").alias("n"), F.grouping(by).alias("_g"), F.grouping(key).alias("_h")).filter("_h = 0")
    return rolled.select(F.when(F.col("_g") == 1, all_).otherwise(F.col(by)).alias(by), key, "n")


def listed_by(df: DataFrame, by: list[str], item: str) -> DataFrame:
    """(by, n, items): the distinct items of each group in order; groups are documents or a document's types."""
    return df.select(*by, item).distinct().groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("items"))


def substituted(text: Column, rules: list[tuple[str, str]]) -> Column:
    """A chain of regular substitutions, in order."""
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def identity(*columns: str) -> Column:
    """A key of a unit's identity: md5 of its columns with a mark between, null as nothing."""
    return F.md5(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


def looked_up(key: Column, names: dict[str, list[str]]) -> Column:
    """The name whose list holds the key, or the key itself if it is a name; null for others."""
    pairs = {m: n for n, members in names.items() for m in members} | {n: n for n in names}
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in sorted(pairs.items()) for x in kv)), key) if pairs else F.lit(None).cast("string")


def side_by_side(a: DataFrame, b: DataFrame, keys: list[str], place: str, token: str) -> DataFrame:
    """(keys, place, a, b): two tokenizations of a text beside each other by place, null where one is shorter."""
    left, right = a.select(*keys, place, F.col(token).alias("a")), b.select(*keys, place, F.col(token).alias("b"))
    return left.join(right, [*keys, place], "full")
