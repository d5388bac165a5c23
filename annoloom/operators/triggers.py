"""Triggers of several parts: joining, choosing and cutting them to a span.

Tokens bring their part of speech (pos), dependency (dep) and the place of their head (head) as columns; places are those
in the sentence or document, ends are inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

PARTS = "array<struct<first:int,last:int>>"


def runs_of_parts(parts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """All runs of neighbouring parts (part_no i <= j) whose last token is less than `most` places after the first: (keys, i, j, first, last).

    parts: keys, part_no, first, last, in order. A self-join inside one trigger, limited by `most` tokens.
    """
    a = parts.select(*keys, F.col("part_no").alias("i"), F.col("first"))
    b = parts.select(*keys, F.col("part_no").alias("j"), F.col("last"))
    return a.join(b, keys).filter((F.col("i") <= F.col("j")) & (F.col("last") - F.col("first") < most))


def best_run(parts: DataFrame, tokens: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Of each trigger's runs (runs_of_parts) the one of greatest ln(content) / (1 + ln(length)), 0 for no content; the first on ties: (keys, i, j, first, last, value).

    Content counts in tokens of the trigger's parts only, length in all tokens from the first to the last. parts: keys,
    part_no, first, last; tokens: doc_id, tok_idx, pos; doc_id is among the keys. A trigger none of whose runs is short
    enough has no row.
    """
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in scalars.CONTENT_WEIGHTS.items() for x in kv)), F.col("pos")), F.lit(0.0))
    inside = parts.select(*keys, F.explode(F.sequence("first", "last")).alias("tok_idx")).distinct()
    weighed = inside.join(tokens.select("doc_id", "tok_idx", "pos"), ["doc_id", "tok_idx"]).select(*keys, "tok_idx", weight.alias("weight"))
    runs = runs_of_parts(parts, keys, most)
    within = runs.join(weighed, keys, "left").groupBy(*keys, "i", "j", "first", "last")
    scored = within.agg(F.sum(F.when(F.col("tok_idx").between(F.col("first"), F.col("last")), F.col("weight")).otherwise(0.0)).alias("content"))
    value = F.when(F.col("content") > 0, F.ln("content") / (1 + F.ln(F.col("last") - F.col("first") + 1))).otherwise(0.0)
    w = Window.partitionBy(*keys).orderBy(F.desc("value"), "i", "j")
    return scored.withColumn("value", value).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*keys, "i", "j", "first", "last", "value")


def filled_span(core_first: Column, core_last: Column, parts: Column, distance: int | None = None) -> Column:
    """The core span and the parts (array of struct first, last) with at most `distance` tokens between them and it, filled up to one contiguous span.

    An overlapping part has none between; without a distance, or with 0, all parts count.
    """
    all_ = F.coalesce(parts, F.array().cast(PARTS))
    between = lambda p: F.greatest(F.lit(0), p["first"] - core_last - 1, core_first - p["last"] - 1)
    near = F.filter(all_, lambda p: between(p) <= distance) if distance else all_
    firsts, lasts = F.concat(F.array(core_first), F.transform(near, lambda p: p["first"])), F.concat(F.array(core_last), F.transform(near, lambda p: p["last"]))
    return F.struct(F.array_min(firsts).alias("first"), F.array_max(lasts).alias("last"))


def with_root(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """tokens (keys, tok_idx, head ...) with root: whether it is the span's root, the first token whose head lies outside the span or is itself or null."""
    inside = tokens.select(*keys, F.col("tok_idx").alias("head"), F.lit(True).alias("_inside")).distinct()
    marked = tokens.join(inside, [*keys, "head"], "left").withColumn("_out", F.col("_inside").isNull() | (F.col("head") == F.col("tok_idx")))
    first = F.min(F.when(F.col("_out"), F.col("tok_idx"))).over(Window.partitionBy(*keys))
    return marked.withColumn("root", F.coalesce(F.col("tok_idx") == first, F.lit(False))).drop("_inside", "_out")


def head_token(tokens: DataFrame, keys: list[str], noun: bool = False) -> DataFrame:
    """The token that stands for a span (keys, tok_idx): its root; with noun, if the root is no NOUN, the first NOUN in the span that hangs on it.

    tokens: keys, tok_idx, head, pos. A span whose tokens' heads form a ring has its first token.
    """
    marked = with_root(tokens, keys)
    own = Window.partitionBy(*keys)
    root = F.coalesce(F.max(F.when(F.col("root"), F.col("tok_idx"))).over(own), F.min("tok_idx").over(own))
    placed = marked.withColumn("_root", root)
    if noun:
        is_root = F.col("tok_idx") == F.col("_root")
        child = (F.col("head") == F.col("_root")) & ~is_root & (F.col("pos") == "NOUN")
        pick = F.when(F.max(F.when(is_root, F.col("pos") == "NOUN").otherwise(False)), F.max("_root")).otherwise(F.coalesce(F.min(F.when(child, F.col("tok_idx"))), F.max("_root")))
    else:
        pick = F.max("_root")
    return placed.groupBy(*keys).agg(pick.alias("tok_idx"))


def truncate(tokens: DataFrame, keys: list[str], width: int, argument: bool = False) -> DataFrame:
    """Spans longer than `width` cut to their window of most content: (keys, first, last); shorter ones as they are, those without content too. tokens: keys, tok_idx, head, pos, dep, contiguous."""
    per = with_root(tokens, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tok_idx", "pos", "dep", "root"))).alias("t"))
    at = scalars.truncated(F.col("t"), width, argument)
    start, n = F.get("t", F.lit(0))["tok_idx"], F.size("t")
    cut = (n > width) & at.isNotNull()
    return per.select(*keys, F.when(cut, start + at).otherwise(start).alias("first"), F.when(cut, start + at + width - 1).otherwise(start + n - 1).alias("last"))


def trigger_span(spans: DataFrame, tokens: DataFrame, keys: list[str], distance: int | None = None, head: str | None = None, width: int = 0) -> DataFrame:
    """A trigger's span by options: filled from core and parts, then its head token (head: "head" or "head_noun"), then cut to `width` tokens (0: not).

    spans: keys, first, last, parts; doc_id is among the keys; tokens: doc_id, tok_idx, head, pos, dep. (keys, first, last)
    """
    filled = spans.select(*keys, filled_span(F.col("first"), F.col("last"), F.col("parts"), distance).alias("x")).select(*keys, "x.first", "x.last")
    if not head and not width:
        return filled
    each = filled.select(*keys, F.explode(F.sequence("first", "last")).alias("tok_idx")).join(tokens.select("doc_id", "tok_idx", "head", "pos", "dep"), ["doc_id", "tok_idx"])
    if head:
        if head not in ("head", "head_noun"):
            raise ValueError(f"no way to choose a head: {head}")
        return head_token(each, keys, head == "head_noun").select(*keys, F.col("tok_idx").alias("first"), F.col("tok_idx").alias("last"))
    return truncate(each, keys, width)
