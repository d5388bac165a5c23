"""Gold and system spans: candidates, greedy and best matches. gold: doc_id, gold_id, first, last and attributes; system: doc_id, annotator, sys_id, first, last and attributes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .spans import span_tokens

PAIR = ["doc_id", "annotator"]


def overlap_candidates(gold: DataFrame, system: DataFrame) -> DataFrame:
    """All pairs that share a token: (doc_id, annotator, gold_id, sys_id, dice); an equi-join on (document, token) that keeps a pair at its first common token only, so nothing is left to aggregate."""
    g = span_tokens(gold.select("doc_id", "gold_id", F.col("first").alias("g_first"), F.col("last").alias("g_last")), "g_first", "g_last")
    s = span_tokens(system.select(*PAIR, "sys_id", F.col("first").alias("s_first"), F.col("last").alias("s_last")), "s_first", "s_last")
    pairs = g.join(s, ["doc_id", "tok_idx"]).filter(F.col("tok_idx") == F.greatest("g_first", "s_first"))
    common = F.least("g_last", "s_last") - F.col("tok_idx") + 1
    return pairs.select(*PAIR, "gold_id", "sys_id", (2.0 * common / (F.col("g_last") - F.col("g_first") + F.col("s_last") - F.col("s_first") + 2)).alias("dice"))


def first_overlaps(candidates: DataFrame) -> DataFrame:
    """Each system span goes to the first gold span it overlaps, in document order, not to the best one."""
    w = Window.partitionBy(*PAIR, "sys_id").orderBy("gold_id")
    return candidates.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def best_per_gold(candidates: DataFrame) -> DataFrame:
    """All candidates tied at a gold span's greatest dice."""
    w = Window.partitionBy(*PAIR, "gold_id").orderBy(F.desc("dice"))
    return candidates.withColumn("_r", F.rank().over(w)).filter("_r = 1").drop("_r")


def mutual_best(candidates: DataFrame) -> DataFrame:
    """Pairs that are best for both sides, ties included."""
    row = F.max("dice").over(Window.partitionBy(*PAIR, "gold_id"))
    column = F.max("dice").over(Window.partitionBy(*PAIR, "sys_id"))
    return candidates.withColumn("_r", row).withColumn("_c", column).filter("dice = _r and dice = _c").drop("_r", "_c")


MATCHERS: dict[str, Callable[[DataFrame], DataFrame]] = {"ere": first_overlaps, "all_overlaps": lambda candidates: candidates}
SELECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"ere": best_per_gold}


def match(gold: DataFrame, system: DataFrame, matcher: str = "ere", selector: str = "ere") -> DataFrame:
    """The strategies by name; an unknown name is an error."""
    if matcher not in MATCHERS or selector not in SELECTORS:
        raise ValueError(f"unknown strategy: {matcher}, {selector}; there are {sorted(MATCHERS)} and {sorted(SELECTORS)}")
    return SELECTORS[selector](MATCHERS[matcher](overlap_candidates(gold, system)))


def taken_once(gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """The older selection: ties at a gold span's best dice are resolved by its place among gold spans of the same tokens, then a system span already taken by an earlier gold span is skipped."""
    places = gold.select("doc_id", "gold_id", F.row_number().over(Window.partitionBy("doc_id", "first", "last").orderBy("gold_id")).alias("place"))
    w = Window.partitionBy(*PAIR, "gold_id").orderBy("sys_id")
    ties = best_per_gold(candidates).withColumn("tie", F.row_number().over(w)).withColumn("ties", F.count("*").over(Window.partitionBy(*PAIR, "gold_id")))
    picked = ties.join(places, ["doc_id", "gold_id"]).filter("tie = least(place, ties)")
    first = Window.partitionBy(*PAIR, "sys_id").orderBy("gold_id")
    return picked.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*PAIR, "gold_id", "sys_id", "dice")


def same_type_in_window(gold: DataFrame, system: DataFrame, type_col: str = "label", sentence: str | None = "sent_idx") -> DataFrame:
    """Pairs of one type in the same sentence (or document, sentence=None) with token_distance, negative inside an overlap."""
    on = ["doc_id", type_col, *([sentence] if sentence else [])]
    g = gold.select(*on, "gold_id", F.col("first").alias("g_first"), F.col("last").alias("g_last"))
    s = system.select(*on, "annotator", "sys_id", F.col("first").alias("s_first"), F.col("last").alias("s_last"))
    return g.join(s, on).withColumn("token_distance", F.greatest(F.col("g_first") - F.col("s_last"), F.col("s_first") - F.col("g_last")))


def text_dice(a: Column, b: Column) -> Column:
    """Dice score of two arrays of words: 1 for the same words as often, else common distinct words over all words; 0 where either is empty."""
    score = 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when(F.array_sort(a) == F.array_sort(b), 1.0).otherwise(score)


def cascade(gold: DataFrame, system: DataFrame, strategy: tuple[str | int, ...] = ("span", "sentence"), type_col: str = "label") -> DataFrame:
    """For each gold span and annotator the match of the first tier that has one: (..., sys_id, how). gold and system also have sent_idx and words.

    "span" takes the best overlap; "sentence", "document" and a number of tokens take, of the spans of the same type there, the one
    with the best text dice, then the nearest. A tier sees only the gold spans that earlier ones left, so few pairs are made.
    """
    keys = [*PAIR, "gold_id"]
    left, found = gold.select("doc_id", "gold_id").join(system.select(*PAIR).distinct(), "doc_id"), []
    for tier in strategy:
        if tier == "span":
            pairs, order, how = overlap_candidates(gold, system), [F.desc("dice")], "span"
        else:
            on = [*PAIR, type_col, *(["sent_idx"] if tier == "sentence" else [])]
            g = left.join(gold, ["doc_id", "gold_id"]).select(*on, "gold_id", F.col("first").alias("g_first"), F.col("last").alias("g_last"), F.col("words").alias("g_words"))
            pairs = g.join(system.select(*on, "sys_id", "first", "last", "words"), on).withColumn("token_distance", F.greatest(F.col("g_first") - F.col("last"), F.col("first") - F.col("g_last")))
            pairs, how = (pairs.filter(F.col("token_distance") <= tier), "window") if isinstance(tier, int) else (pairs, tier)
            order = [F.desc(text_dice(F.col("g_words"), F.col("words"))), F.asc("token_distance")]
        best = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "sys_id"))).filter("_n = 1")
        found.append(stored(best.select(*keys, "sys_id", F.lit(how).alias("how"))))
        left = left.join(found[-1], keys, "left_anti")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def with_missing(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both sides' labels of every matched pair and of what has no match, 'NaN' for the other side. left: doc_id, left_id, left_label; right: doc_id, right_id, right_label; pairs: doc_id, left_id, right_id."""
    matched = left.join(pairs, ["doc_id", "left_id"], "left").join(right, ["doc_id", "right_id"], "full")
    return matched.select("doc_id", "left_id", "right_id", F.coalesce("left_label", F.lit("NaN")).alias("left_label"), F.coalesce("right_label", F.lit("NaN")).alias("right_label"))
