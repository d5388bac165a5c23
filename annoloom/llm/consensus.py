"""Consensus of several annotators by message passing on the item-annotator graph, one class against the rest.

For each class a label is +1 or -1, centred and scaled by the class's share, so that rare classes don't pass for
agreement. Items send each annotator the others' labels, weighted by the messages these sent; annotators send each item
how well they agree with such messages elsewhere. An item's message is divided by the strength of those who speak, so that
the messages to items settle at the annotators' correlations with the truth. (The sums of Karger, Oh and Shah, 2011, rank a
good annotator among weak ones too low when there are only three.) Items with the same labels by the same annotators send
the same messages: they are one node with a multiplicity, and the loop runs over label patterns, of which there are at most
(types + 1) ^ annotators, not items. A pattern's edges in one class are one row, so a round is one small aggregation and no
join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import release, stored


def type_key(name: Column) -> Column:
    """A type's name without case, spaces and punctuation; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", ""), F.lit(""))


def main_types(items: DataFrame, cells: list[str], typology: DataFrame, slip: int = 6) -> DataFrame:
    """items with each cell replaced by the main type it names, in whatever case, spacing or punctuation, with few slips, else null.

    A cell names the type from which it differs by the fewest edits, if these are at most a sixth of the longer one's
    characters. typology: full_name, maintype_name, a fixed list of types, which becomes a literal. The distinct spellings
    are stored first, so that each is compared once, not once a cell. Of main types equally near the first by name counts.
    """
    names = typology.select(F.explode(F.array(F.struct("full_name", "maintype_name"), F.struct(F.col("maintype_name").alias("full_name"), "maintype_name"))).alias("x")).select("x.*")
    types = names.select(type_key(F.col("full_name")).alias("key"), "maintype_name").dropna().distinct().orderBy("key", "maintype_name").collect()
    keyed = items.withColumns({c: type_key(F.col(c)) for c in cells})
    if not types:
        return keyed.withColumns({c: F.lit(None).cast("string") for c in cells})
    known = F.array(*(F.struct(F.lit(t.key).alias("key"), F.lit(t.maintype_name).alias("main")) for t in types))
    spellings = stored(keyed.select(F.explode(F.array(*cells)).alias("spelling")).filter("spelling is not null").distinct())
    d = lambda t: F.levenshtein(t["key"], F.col("spelling"))
    near = F.array_min(F.transform(F.filter(known, lambda t: slip * d(t) <= F.greatest(F.length(t["key"]), F.length("spelling"))), lambda t: F.struct(d(t).alias("d"), t["main"].alias("main"))))
    named = stored(spellings.withColumn("near", near).filter("near is not null").select("spelling", F.col("near.main").alias("main")))
    out = keyed
    for c in cells:
        out = out.join(named.select(F.col("spelling").alias(c), F.col("main").alias(f"{c}__main")), c, "left").drop(c).withColumnRenamed(f"{c}__main", c)
    return out


def latest(items: DataFrame, item: str, time: str, cells: list[str]) -> DataFrame:
    """Each item's row of the latest time; of several ones that with the greatest cells, nulls least."""
    last = items.groupBy(item).agg(F.max(F.struct(time, *cells)).alias("last"))
    return last.select(item, *(F.col("last")[c].alias(c) for c in cells))


def reliabilities(items: DataFrame, annotators: list[str], tolerance: float = 1e-3, max_rounds: int = 60, prior: float = 30.0) -> DataFrame:
    """(annotator, reliability, n_labels) from wide items, one column of labels for each annotator, null where there is none.

    reliability in [-1, 1]: the mean message of all items to the annotator, an estimate of the correlation of the labels
    with the true ones, averaged over classes by their share. In rare classes an annotator's message leans on that over all classes, as if
    `prior` more items had said so. Without any item of two labels, or with one class only, it
    is 0 for all. What is collected are sums, one for each class and annotator, both fixed lists.
    """
    k = range(len(annotators))
    own = [f"l{i}" for i in k]
    labelled = reduce(lambda x, y: x + y, (F.col(c).isNotNull().cast("int") for c in own))
    patterns = stored(items.select(*(F.col(a).alias(c) for a, c in zip(annotators, own))).groupBy(*own).agg(F.count("*").alias("w")).withColumn("n_labels", labelled).filter("n_labels > 0"))
    given = F.explode(F.array(*(F.struct(F.lit(a).alias("annotator"), F.col(c).alias("class")) for a, c in zip(annotators, own)))).alias("v")
    labels = patterns.select("w", "n_labels", given).filter("v.class is not null")
    counts = labels.groupBy(F.col("v.annotator").alias("annotator")).agg(F.sum("w").alias("n_labels"))
    votes_of = labels.filter("n_labels > 1").groupBy(F.col("v.class").alias("class")).agg(F.sum("w").alias("n"))
    share = (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share")  # a window over the classes
    classes = {r["class"]: r.share for r in votes_of.select("class", share).filter("share < 1").collect()}
    if not classes:
        return counts.select("annotator", F.lit(0.0).alias("reliability"), "n_labels")
    every = F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.lit(s).alias("share")) for c, s in sorted(classes.items())))).alias("c")
    spread = F.sqrt(F.col("c.share") * (1 - F.col("c.share")))
    signed = lambda a: F.when(F.col(a).isNotNull(), (F.when(F.col(a) == F.col("c.class"), 1.0).otherwise(0.0) - F.col("c.share")) / spread)
    state = patterns.filter("n_labels > 1").select("*", every).select("w", F.col("c.class").alias("class"), *(signed(c).alias(f"a{i}") for i, c in enumerate(own)), *(F.lit(1.0).alias(f"y{i}") for i in k), F.lit(0.0).alias("moved"))
    state = stored(state)
    for done in range(max_rounds + 1):
        sums = _sums(state, k)
        moved, all_ = sum(r.moved for r in sums), sum(r.all for r in sums)
        if done == max_rounds or done and (not all_ or moved / all_ < tolerance):
            break
        new = stored(_round(state, sums, k, classes, prior))
        release(state)
        state = new
    release(state)
    ends = {a: max(-1.0, min(1.0, r)) for a, r in zip(annotators, _overall(sums, k, classes)) if r is not None}
    known = F.create_map(*(F.lit(x) for kv in sorted(ends.items()) for x in kv))
    return counts.select("annotator", F.coalesce(F.try_element_at(known, F.col("annotator")), F.lit(0.0)).alias("reliability"), "n_labels")


def _told(k: range) -> list[str]:
    """What each item tells each of its annotators, the labels of the others by their strength: x0, x1 ... in SQL, over a0.. and y0.. of one row."""
    one = [f"coalesce(a{i} * y{i}, 0d)" for i in k]
    power = [f"if(a{i} is null, 0d, y{i} * y{i})" for i in k]
    return [f"*, {' + '.join(one)} as _s, {' + '.join(power)} as _q", f"*, {', '.join(f'if(_q - {power[i]} > 1e-9, (_s - {one[i]}) / (_q - {power[i]}), 0d) as x{i}' for i in k)}"]


def _with_messages(state: DataFrame, k: range) -> DataFrame:
    first, second = _told(k)
    return state.selectExpr(*_split(first)).selectExpr(*_split(second))


def _split(columns: str) -> list[str]:
    """A select list at its outer commas."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[last:i])
            last = i + 1
    return [*out, columns[last:]]


def _sums(state: DataFrame, k: range) -> list:
    """What each annotator hears in each class, and how far the messages moved: a row for each class, a fixed list of types."""
    heard = [f"sum(w * a{i} * x{i}) as t{i}" for i in k] + [f"coalesce(sum(if(a{i} is null, null, w)), 0) as n{i}" for i in k]
    weight = " + ".join(f"if(a{i} is null, 0d, abs(y{i}))" for i in k)
    return _with_messages(state, k).groupBy("class").agg(*map(F.expr, [*heard, "sum(w * moved) as moved", f"sum(w * ({weight})) as all"])).collect()


def _overall(sums: list, k: range, classes: dict[str, float]) -> list[float | None]:
    """What each annotator hears over all classes, by their share."""
    heard = [[(classes[r["class"]], r[f"t{i}"] / r[f"n{i}"]) for r in sums if r[f"n{i}"]] for i in k]
    return [sum(w * t for w, t in own) / sum(w for w, _ in own) if own else None for own in heard]


def _round(state: DataFrame, sums: list, k: range, classes: dict[str, float], prior: float) -> DataFrame:
    """One exchange of messages; those to the items go, against oscillation, halfway from the last ones and, as they estimate correlations, between -1 and 1. The classes' sums, a fixed list, come as one literal map."""
    all_ = [x or 0.0 for x in _overall(sums, k, classes)]
    pairs = [x for r in sums for x in (F.lit(r["class"]), F.array(*(F.lit(float(x)) for i in k for x in ((r[f"t{i}"] or 0.0) + prior * all_[i], r[f"n{i}"] + prior))))]
    told = _with_messages(state, k).withColumn("_h", F.try_element_at(F.create_map(*pairs), F.col("class")))
    answer = [f"coalesce(greatest(-1d, least(1d, (if(_h[{2 * i + 1}] > 1, (_h[{2 * i}] - a{i} * x{i}) / (_h[{2 * i + 1}] - 1), 0d) + y{i}) / 2)), y{i}) as _y{i}" for i in k]
    moved = " + ".join(f"if(a{i} is null, 0d, abs(_y{i} - y{i}))" for i in k)
    new = told.selectExpr("*", *answer)
    return new.selectExpr("w", "class", *(f"a{i}" for i in k), *(f"_y{i} as y{i}" for i in k), f"{moved} as moved")


def consensus(items: DataFrame, item: str, annotators: list[str], scores: DataFrame) -> DataFrame:
    """(item, label, n_labels, n_agree, agreement, tied): the label that leads, else that of the most reliable annotator who labelled the item.

    scores: annotator, reliability, one row for each column in annotators (equal ones in order of name). agreement is the
    share of agreeing pairs of labels. Items with fewer than two labels give no row.
    """
    order = [r.annotator for r in scores.orderBy(F.desc("reliability"), "annotator").collect()]
    order += sorted(set(annotators) - set(order))
    labels = F.filter(F.array(*annotators), lambda x: x.isNotNull())
    tallies = F.transform(F.array_distinct("labels"), lambda v: F.struct(F.size(F.filter("labels", lambda x: x == v)).alias("n"), v.alias("label")))
    counted = items.withColumn("labels", labels).filter(F.size("labels") >= 2).withColumn("tally", tallies).withColumn("best", F.array_max("tally"))
    leaders = F.size(F.filter("tally", lambda t: t["n"] == F.col("best.n")))
    pairs = F.aggregate("tally", F.lit(0.0), lambda s, t: s + t["n"] * (t["n"] - 1))
    n = F.size("labels")
    return counted.select(
        item,
        F.when(leaders == 1, F.col("best.label")).otherwise(F.coalesce(*(F.col(a) for a in order))).alias("label"),
        n.alias("n_labels"), F.col("best.n").alias("n_agree"), (pairs / (n * (n - 1))).alias("agreement"), (leaders > 1).alias("tied"),
    )
