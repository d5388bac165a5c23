"""Queries over the training-data operators; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, stored
from ..sources.tables import table
from .consensus import consensus, latest, main_types, reliabilities
from .groups import mention_groups
from .mixing import mix, share_report, source_key
from .packing import fill_report, pack
from .pages import pages_without_sentences, score_pages
from .splits import annotator_number, assign_splits, document_key
from .sql import ORACLES  # noqa: F401
from .tokens import token_count


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = table(spark, sf_dir, "elements").select("doc_uid", "document_title", "annotator_id", "layer")
    return assign_splits(elements, table(spark, sf_dir, "split_targets"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_splits(spark, sf_dir).filter("group_annotator is not null and doc_uid is not null").select("doc_uid", "group_annotator")


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = p2_splits(spark, sf_dir).groupBy("split_name").agg(F.count("*").alias("n_documents"), F.sum("n_rows").alias("n_rows"))
    total = F.sum(F.coalesce("n_rows", F.lit(0))).over(_all())
    return table(spark, sf_dir, "split_targets").join(reached, "split_name", "left").select(
        "split_name", "target_share", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.try_divide(F.coalesce("n_rows", F.lit(0)), total).alias("share_reached"),
    )


def _all():
    """A frame over a handful of report rows."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def p2_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the splits promise: every doc_uid has one, and no document or annotator has two."""
    splits = stored(p2_splits(spark, sf_dir))
    rows = table(spark, sf_dir, "elements").select("doc_uid", document_key(F.col("document_title")).alias("document"), annotator_number(F.col("annotator_id")).alias("annotator")).distinct()
    keys = rows.select("doc_uid", F.explode(F.array(F.struct(F.lit("document").alias("kind"), F.col("document").alias("key")), F.struct(F.lit("annotator").alias("kind"), F.col("annotator").cast("string").alias("key")))).alias("x")).select("doc_uid", "x.*").filter("key is not null")
    torn = keys.join(splits.select("doc_uid", "split_name"), "doc_uid").groupBy("kind", "key").agg(F.count_distinct("split_name").alias("n"))
    per = torn.groupBy("kind").agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_torn"))
    return per.unionByName(splits.agg(F.lit("doc_uid").alias("kind"), F.count_distinct("doc_uid").alias("n_keys"), (F.count("doc_uid") - F.count_distinct("doc_uid")).alias("n_torn")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mention_groups(table(spark, sf_dir, "canonrefs")).filter("doc_uid is not null")


ANNOTATORS = ["anno_01", "anno_02", "anno_03"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = latest(table(spark, sf_dir, "events_event_type").filter("item_id is not null"), "item_id", "exported_at", ANNOTATORS)
    typology = table(spark, sf_dir, "typology").select("full_name", "maintype_name")
    return stored(main_types(last, ANNOTATORS, typology))


def p4_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliabilities(_labels(spark, sf_dir), ANNOTATORS)


def p4_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    return consensus(labels, "item_id", ANNOTATORS, reliabilities(labels, ANNOTATORS))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_consensus(spark, sf_dir).select("item_id", "label")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each text, counted once."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return stored(documents.select("doc_id", "source", "lang", F.md5("text").alias("text_key"), token_count(F.col("text")).alias("n_tokens")))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_sizes(spark, sf_dir).select(F.col("doc_id").alias("item_id"), "n_tokens"), table(spark, sf_dir, "pack_capacities"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p6_containers(spark, sf_dir))


# The tree's upper level as a table, as a user of mix() brings one: sources of a kind take over from each other first.
DOMAINS = (
    ("news", ("newswire", "regional_press", "archive", "radio_script")),
    ("company", ("press_release", "filing", "transcript", "broker_note")),
    ("social", ("blog", "forum")),
    ("sample", ("gold_sample", "iaa_sample")),
)


def _domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, d) for d, sources in DOMAINS for s in sources], "source string, domain string")


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the containers promise: every item is there, none is overfull, only items over the capacity are cut, pieces follow each other."""
    packed = stored(p6_containers(spark, sf_dir))
    full = packed.filter("container_id is not null").groupBy("capacity_name", "container_id").agg((F.sum("n_tokens") > F.max("capacity_tokens")).alias("bad")).groupBy("capacity_name").agg(F.count_if("bad").alias("n_overfull"))
    item = packed.groupBy("capacity_name", "item_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("size"), F.max("capacity_tokens").alias("cap"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"))
    cut, gap = (F.col("n") > 1) & (F.col("size") <= F.col("cap")), F.col("end") != F.col("size")
    return item.groupBy("capacity_name").agg(F.count("*").alias("n_items"), F.count_if(cut).alias("n_cut_small"), F.count_if(gap).alias("n_gaps")).join(full, "capacity_name")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"), _domains(spark))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return share_report(sizes, mix(sizes, targets, _domains(spark)), targets)


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_pages(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "title", "ticker")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_without_sentences(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "title", "ticker"))).select("doc_id")


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix promises, for each targeted source: no text is drawn more often than allowed, none under two ids."""
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    drawn = mix(sizes, targets, _domains(spark)).join(sizes.select("doc_id", "text_key"), "doc_id")
    per = drawn.groupBy("source", "text_key").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"))
    wanted = targets.select(source_key(F.col("source")).alias("source"), "max_repeats")
    return wanted.join(per, "source", "left").groupBy("source").agg(F.count_if(F.col("n") > F.col("max_repeats")).alias("n_too_often"), F.count_if(F.col("ids") > 1).alias("n_twice"))


QUERIES = {f.__name__: f for f in (p2_found, p2_splits, p2_shares, p2_checks, p3_found, p4_found, p4_consensus, p4_reliability, p6_containers, p6_fill, p6_checks, p7_mixture, p7_shares, p7_checks, p8_found, p8_scores)}

