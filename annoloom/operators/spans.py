"""Spans of tokens: overlap, containment, interval unions, tags. A span is (first, last), both inclusive, inside a document.

All joins are equi-joins on the document and a token, never theta joins over whole documents. Spans with a null end or
first > last hold no token and match nothing; repeated spans are spans of their own if their ids differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays: shared distinct members twice over both lengths, repeats counting in the length; 0 if either is empty or null."""
    n, m = F.size(F.coalesce(a, F.array())), F.size(F.coalesce(b, F.array()))
    return F.when((n > 0) & (m > 0), 2.0 * F.size(F.array_intersect(a, b)) / (n + m)).otherwise(0.0)


def span_tokens(spans: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """One row for each token of each span, with the span's columns."""
    return spans.filter(F.col(first) <= F.col(last)).withColumn("tok_idx", F.explode(F.sequence(first, last)))


def tokens_in_spans(tokens: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Containment join of tokens and spans by exploded token positions."""
    return span_tokens(spans).join(tokens, [*keys, "tok_idx"])


def sentence_of_spans(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """spans with sent_idx, the sentence that holds the whole span; null where it crosses a sentence's end or has no tokens."""
    sent = tokens.select("doc_id", F.col("tok_idx").alias("_tok"), F.col("sent_idx").alias("_sent"))
    start = sent.select("doc_id", F.col("_tok").alias("first"), F.col("_sent").alias("sent_first"))
    end = sent.select("doc_id", F.col("_tok").alias("last"), F.col("_sent").alias("sent_last"))
    joined = spans.join(start, ["doc_id", "first"], "left").join(end, ["doc_id", "last"], "left")
    return joined.withColumn("sent_idx", F.when(F.col("sent_first") == F.col("sent_last"), F.col("sent_first"))).drop("sent_first", "sent_last")


def interval_union(df: DataFrame, keys: list[str], begin: str, end: str, touching: bool = False, order: tuple[str, ...] = ()) -> DataFrame:
    """df with group_no, numbering the unions of overlapping intervals [begin, end) from 1 in each key, and the union's group_begin and group_end.

    Intervals that only touch stay apart unless touching is set. Rows with a null end of the interval have a null group_no.
    """
    w = Window.partitionBy(*keys).orderBy(begin, end, *order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(begin) > reach if touching else F.col(begin) >= reach
    usable = df.filter(F.col(begin).isNotNull() & F.col(end).isNotNull())
    flagged = usable.withColumn("_new", F.when(reach.isNull() | apart, 1).otherwise(0))
    numbered = flagged.withColumn("group_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    own = Window.partitionBy(*keys, "group_no")
    grouped = numbered.withColumn("group_begin", F.min(begin).over(own)).withColumn("group_end", F.max(end).over(own))
    return grouped.unionByName(df.filter(F.col(begin).isNull() | F.col(end).isNull()), allowMissingColumns=True)


def exact_overlaps(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of spans with the very same tokens: (keys, first, last, n_spans), only those of two and more."""
    return spans.groupBy(*keys, "first", "last").agg(F.count("*").alias("n_spans")).filter("n_spans > 1")


def bio_tags(tokens: DataFrame, units: DataFrame, keys: list[str], order: str) -> DataFrame:
    """tokens with tag: B on a unit's first token, I on the others, O elsewhere; of overlapping units the later one in `order` overwrites."""
    marked = span_tokens(units).select(*keys, "tok_idx", F.struct(F.col(order).alias("o"), F.when(F.col("tok_idx") == F.col("first"), "B").otherwise("I").alias("tag")).alias("m"))
    last = marked.groupBy(*keys, "tok_idx").agg(F.max("m").alias("m"))
    return tokens.join(last, [*keys, "tok_idx"], "left").withColumn("tag", F.coalesce("m.tag", F.lit("O"))).drop("m")


def merge_touching(parts: DataFrame, keys: list[str], gap: int = 1) -> DataFrame:
    """Parts of a trigger whose token ranges touch or overlap (next first <= last so far + gap) as one: (keys, part_no, first, last, n_parts)."""
    w = Window.partitionBy(*keys).orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = parts.withColumn("_new", F.when(reach.isNull() | (F.col("first") > reach + gap), 1).otherwise(0))
    no = new.withColumn("part_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return no.groupBy(*keys, "part_no").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n_parts"))


def capped_extension(core_first: Column, core_last: Column, parts: Column, cap: int = 24) -> Column:
    """A core span that takes in the parts (array of struct first, last), left to right, as long as gap and length stay under cap; each one moves the core."""
    start = F.struct(core_first.cast("int").alias("first"), core_last.cast("int").alias("last"))

    def take(core: Column, part: Column) -> Column:
        gap = F.greatest(F.lit(0), part["first"] - core["last"], core["first"] - part["last"])
        joined = F.struct(F.least(core["first"], part["first"]).cast("int").alias("first"), F.greatest(core["last"], part["last"]).cast("int").alias("last"))
        return F.when(gap + part["last"] - part["first"] + 1 < cap, joined).otherwise(core)

    return F.aggregate(F.array_sort(parts), start, take)


def span_distance(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    """Tokens from one span's end to the other's start, 0 where they overlap."""
    return F.greatest(F.lit(0), b_first - a_last, a_first - b_last)


def windows(items: Column, width: int) -> Column:
    """All runs of `width` neighbours of an array, in order; none if it is shorter or null."""
    last = F.size(F.coalesce(items, F.array())) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.slice(items, i, width))).otherwise(F.array())
