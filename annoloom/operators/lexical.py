"""Lexical richness of groups of tokens. tokens: the group's columns, tok, and an order column; null tokens don't count."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def basic_richness(tokens: DataFrame, by: list[str], tok: str = "tok") -> DataFrame:
    """Tokens w, types t, and the closed forms; ratios without a value (one token, t = w) are null."""
    types = tokens.filter(F.col(tok).isNotNull()).groupBy(*by, tok).agg(F.count("*").alias("n"))
    per = types.groupBy(*by).agg(F.sum("n").alias("w"), F.count("*").alias("t"))
    w, t = F.col("w").cast("double"), F.col("t").cast("double")
    ln = lambda x: F.when(x > 0, F.ln(x))
    return per.select(
        *by, "w", "t", (t / w).alias("ttr"), (t / F.sqrt(w)).alias("rttr"), (t / F.sqrt(2 * w)).alias("cttr"), F.try_divide(ln(t), ln(w)).alias("herdan"),
        F.try_divide(ln(ln(t)), ln(ln(w))).alias("summer"), F.try_divide(ln(w) ** 2, ln(w) - ln(t)).alias("dugast"), F.try_divide(ln(w) - ln(t), ln(w) ** 2).alias("maas"),
    )


def entropy(mentions: DataFrame, by: list[str], value: str) -> DataFrame:
    """Entropy in bits over whole values; nulls don't count."""
    counts = mentions.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.sum("n").alias("w"), F.sum(F.col("n") * F.log2("n")).alias("s")).select(*by, (F.log2("w") - F.col("s") / F.col("w")).alias("entropy"))


def hdd(tokens: DataFrame, by: list[str], tok: str = "tok", draws: int = 42) -> DataFrame:
    """HD-D: the chance of each type in a sample of `draws` tokens, over draws; groups of fewer tokens have none.

    Types of one frequency have one chance, so the product is computed once for each (group, frequency).
    """
    types = tokens.filter(F.col(tok).isNotNull()).groupBy(*by, tok).agg(F.count("*").alias("n"))
    freq = types.groupBy(*by, "n").agg(F.count("*").alias("types"))
    total = types.groupBy(*by).agg(F.sum("n").alias("w")).filter(F.col("w") >= draws)
    w, n = F.col("w").cast("double"), F.col("n").cast("double")
    absent = F.aggregate(F.sequence(F.lit(0), F.lit(draws - 1)), F.lit(1.0), lambda acc, i: acc * F.greatest(F.lit(0.0), w - n - i) / (w - i))
    return freq.join(total, by).groupBy(*by).agg((F.sum(F.col("types") * (1 - absent)) / draws).alias("hdd"))


def _with(df: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """df with the other columns of side, which has one row a key; null keys are equal."""
    named = side.withColumnsRenamed({c: f"_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(named, same).drop(*(f"_{c}" for c in on))


def _places(tokens: DataFrame, by: list[str], order: list[str], tok: str, parts: int = 1024) -> DataFrame:
    """(by, tok, p): the tokens with their place in the group from 0. Of several order columns the first is a whole number, such as a document's:
    places are counted inside ranges of it and added up over the ranges, so that no task sorts a large group."""
    kept = tokens.filter(F.col(tok).isNotNull())
    if len(order) == 1:
        return kept.select(*by, tok, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long").alias("p"))
    bounds = kept.agg(F.min(order[0]).alias("lo"), F.max(order[0]).alias("hi")).first()
    step = max(1, -(-((bounds.hi or 0) - (bounds.lo or 0) + 1) // parts))
    ranged = kept.withColumn("part", F.floor((F.col(order[0]) - (bounds.lo or 0)) / step))
    sums = ranged.groupBy(*by, "part").agg(F.count("*").alias("n"))
    before = sums.select(*by, "part", (F.sum("n").over(Window.partitionBy(*by).orderBy("part")) - F.col("n")).alias("before"))
    inside = ranged.select(*by, tok, "part", (F.row_number().over(Window.partitionBy(*by, "part").orderBy(*order)) - 1).alias("inside"))
    return _with(inside, before, [*by, "part"]).select(*by, tok, (F.col("before") + F.col("inside")).alias("p"))


def msttr(tokens: DataFrame, by: list[str], order: list[str], tok: str = "tok", segment: int = 25) -> DataFrame:
    """Mean type-token ratio of consecutive full segments."""
    placed = _places(tokens, by, order, tok)
    per = placed.groupBy(*by, F.floor(F.col("p") / segment).alias("s")).agg(F.count("*").alias("n"), F.countDistinct(tok).alias("t"))
    return per.filter(F.col("n") == segment).groupBy(*by).agg(F.avg(F.col("t") / segment).alias("msttr"))


def mattr(tokens: DataFrame, by: list[str], order: list[str], tok: str = "tok", window: int = 25, block: int = 65536) -> DataFrame:
    """Mean type-token ratio of all windows: a token counts in the windows after its last occurrence, so no window is built.

    Last occurrences are looked for inside blocks of places that also have the window before them; older ones make no difference.
    """
    placed = _places(tokens, by, order, tok)
    at = F.floor(F.col("p") / block)
    shown = placed.select("*", F.explode(F.when(F.col("p") % block > block - window, F.array(at, at + 1)).otherwise(F.array(at))).alias("block"))
    last = F.lag("p").over(Window.partitionBy(*by, "block", tok).orderBy("p"))
    own = shown.withColumn("prev", F.coalesce(last, F.lit(-1))).filter(at == F.col("block"))
    sized = _with(own, placed.groupBy(*by).agg(F.count("*").alias("w")), by).filter(F.col("w") >= window)
    first = F.greatest(F.col("prev") + 1, F.col("p") - (window - 1), F.lit(0))
    newest = F.least(F.col("p"), F.col("w") - window)
    return sized.groupBy(*by).agg((F.sum(F.greatest(F.lit(0), newest - first + 1)) / ((F.max("w") - (window - 1)) * window)).alias("mattr"))


def _factors(tokens: list[str], threshold: float) -> float:
    factors, seen, n = 0.0, set(), 0
    for t in tokens:
        seen.add(t)
        n += 1
        if len(seen) / n <= threshold:
            factors, seen, n = factors + 1, set(), 0
    return factors + ((1 - len(seen) / n) / (1 - threshold) if n else 0.0)


def mtld(tokens: DataFrame, by: list[str], order: list[str], tok: str = "tok", threshold: float = 0.72) -> DataFrame:
    """MTLD, the mean of both directions; null where no factor comes about. One group is a task's unit: the measure is a sequential pass by definition."""
    types = tokens.select(*by).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        words = pdf.sort_values(order)[tok].tolist()
        runs = [len(words) / f if (f := _factors(x, threshold)) else None for x in (words, words[::-1])]
        out = pdf.iloc[:1][by].copy()
        out["mtld"] = sum(runs) / 2 if None not in runs else None
        return out

    return tokens.filter(F.col(tok).isNotNull()).select(*by, *order, tok).groupBy(*by).applyInPandas(one, f"{columns}, mtld double")


def average_rank(column: str, ascending: bool = False) -> Column:
    """Average rank of ties, cut to a whole number; over a report's rows. Nulls have none."""
    w = Window.partitionBy(F.col(column).isNull()).orderBy(F.col(column) if ascending else F.desc(column))
    ties = F.count("*").over(Window.partitionBy(column))
    return F.when(F.col(column).isNotNull(), F.floor(F.rank().over(w) + (ties - 1) / 2).cast("int"))


def ranked(df: DataFrame, columns: list[str], ascending: tuple[str, ...] = ("maas",)) -> DataFrame:
    """df with rank_<c> for each column, their sum and the rank of the sum."""
    out = df.withColumns({f"rank_{c}": average_rank(c, c in ascending) for c in columns})
    out = out.withColumn("rank_sum", sum((F.coalesce(f"rank_{c}", F.lit(0)) for c in columns[1:]), F.coalesce(f"rank_{columns[0]}", F.lit(0))))
    return out.withColumn("rank_all", average_rank("rank_sum", True))


def without_stop_words(text: Column, stop_words: list[str]) -> Column:
    """The words of a text (between blanks) that are no stop words, whatever their case; null stays null."""
    stops = F.array(*(F.lit(w.lower()) for w in stop_words)) if stop_words else F.array().cast("array<string>")
    return F.array_join(F.filter(F.split(F.trim(text), r"\s+"), lambda w: ~F.array_contains(stops, F.lower(w))), " ")
