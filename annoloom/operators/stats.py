"""Counts, shares, rollups and other corpus statistics; plain aggregations that combine before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_avg(docs: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """One row: documents, units, and units a document; documents without units count."""
    n = units.groupBy(key).agg(F.count("*").alias("n"))
    return docs.select(key).join(n, key, "left").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_units"), F.avg(F.coalesce("n", F.lit(0))).alias("mean_units"))


def shares(df: DataFrame, by: list[str], within: list[str] | None = None, keep_null: bool = True) -> DataFrame:
    """n and share (of all, or within a group) of each value; keep_null=False leaves rows with a null value out."""
    rows = df if keep_null else df.dropna(subset=by)
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"))
    if within:
        return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))
    total = rows.agg(F.count("*").alias("_total")).withColumn("_one", F.lit(1))  # one row, so that no task sorts all values
    return counted.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select(*by, "n", (F.col("n") / F.col("_total")).alias("share"))


def type_rollup(df: DataFrame, main: str, sub: str, unspecified: str = "unspecified") -> DataFrame:
    """Counts by type and subtype, a null subtype as `unspecified`, with a subtotal (sub null) for types of more than one subtype."""
    named = df.select(main, F.coalesce(sub, F.lit(unspecified)).alias(sub))
    rolled = named.rollup(main, sub).agg(F.count("*").alias("n"), F.grouping_id(main, sub).alias("g"), F.countDistinct(sub).alias("subs"))
    return rolled.filter("g = 0 or (g = 1 and subs > 1)").select(main, sub, "n")


def role_ratios(df: DataFrame, kind: str, role: str) -> DataFrame:
    """n of each role in each type and n_over_type_participants, its share of the type's participants (not of its events)."""
    return shares(df, [kind, role], [kind], keep_null=False).withColumnRenamed("share", "n_over_type_participants")


def median_like(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """In each group the row whose value is nearest to the mean, the first in `order` on ties."""
    mean = df.groupBy(*by).agg(F.avg(value).alias("_mean"))
    near = df.filter(F.col(value).isNotNull()).join(mean, by).groupBy(*by).agg(F.min_by(F.struct(order, value), F.struct(F.abs(F.col(value) - F.col("_mean")), F.col(order))).alias("x"))
    return near.select(*by, f"x.{order}", f"x.{value}")


def regressions(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Slope, intercept and r2 of y on x and of y on ln x (x > 0); null where x doesn't vary."""
    lx = F.when(F.col(x) > 0, F.ln(x))
    fits = lambda v, p: [F.regr_slope(y, v).alias(f"{p}slope"), F.regr_intercept(y, v).alias(f"{p}intercept"), F.regr_r2(y, v).alias(f"{p}r2")]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *fits(F.col(x), ""), *fits(lx, "log_"))


def percentile_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """For each distinct value 50 x (share below + share not above + its own row once): the rank kind of percentile of score."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*(by or []), value).agg(F.count("*").alias("n"))
    part = Window.partitionBy(*(by or [F.lit(1)]))
    upto = F.sum("n").over(part.orderBy(value))
    return counts.withColumn("percentile", 50.0 * ((upto - F.col("n")) + upto + 1) / F.sum("n").over(part))


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their sample standard deviation; over a report's rows."""
    every = Window.partitionBy(F.lit(1))
    return df.withColumns({f"z_{c}": F.try_divide(F.col(c) - F.avg(c).over(every), F.stddev_samp(c).over(every)) for c in columns})


def tuples(df: DataFrame, by: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """Non-overlapping n-tuples of values in order; a rest is dropped."""
    placed = df.withColumn("_p", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    grouped = placed.groupBy(*by, F.floor(F.col("_p") / n).alias("tuple_no")).agg(F.array_sort(F.collect_list(F.struct("_p", value))).alias("x"))
    return grouped.filter(F.size("x") == n).select(*by, "tuple_no", F.transform("x", lambda y: y[value]).alias("members"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows in equal bins of [low, high), 0 below and bins + 1 above."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.width_bucket(F.col(value).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def company_letters(title: Column) -> Column:
    """The key of a company: letters of the part before the first underscore; null for titles that start with a digit."""
    head = F.regexp_replace(F.split_part(title, F.lit("_"), F.lit(1)), "[0-9]", "")
    return F.when(~title.rlike("^[0-9]"), head)


def full_outer(frames: dict[str, DataFrame], key: str, value: str, fill: int = 0) -> DataFrame:
    """An n-way full outer join of (key, value) frames as one union and one aggregation: a column for each name, filled."""
    parts = [df.select(key, *(F.col(value).alias(n) if n == name else F.lit(None).cast("long").alias(n) for n in frames)) for name, df in frames.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(key).agg(*(F.coalesce(F.sum(n), F.lit(fill)).alias(n) for n in frames))
