"""Connected components by alternating large-star and small-star edge rewrites (Kiveris et al., 2014).

Edges are kept as (hi, lo) with hi > lo, optionally inside a scope. With m(u) the least of u and its smaller neighbours,
large-star turns (hi, lo) into (hi, m(lo)), small-star turns it into (lo, m(hi)) and (hi, m(hi)). Both are an aggregation
that combines before its shuffle and a join whose other side has one row a node, so a hub splits as a skewed join does.
At the end every node hangs on its component's least member; rounds grow with the logarithm of a chain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored_with


def symmetric(edges: DataFrame, scope: list[str], a: str, b: str) -> DataFrame:
    """Both directions of each edge, once each; null ends and edges of a node to itself are left out."""
    ok = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return ok.select(*scope, F.col(a).alias("src"), F.col(b).alias("dst")).unionByName(ok.select(*scope, F.col(b).alias("src"), F.col(a).alias("dst"))).distinct()


def _least(edges: DataFrame, scope: list[str], node: str) -> DataFrame:
    return edges.groupBy(*scope, F.col("hi").alias(node)).agg(F.min("lo").alias("least"))


def _large_star(edges: DataFrame, scope: list[str]) -> DataFrame:
    return edges.join(_least(edges, scope, "lo"), [*scope, "lo"], "left").select(*scope, "hi", F.coalesce("least", "lo").alias("lo")).distinct()


def _small_star(edges: DataFrame, scope: list[str]) -> DataFrame:
    pairs = F.array(F.struct(F.col("hi").alias("hi"), F.col("least").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))
    return edges.join(_least(edges, scope, "hi"), [*scope, "hi"]).select(*scope, F.inline(pairs)).filter("hi <> lo").distinct()


def _with_open(edges: DataFrame, scope: list[str]) -> DataFrame:
    """edges with open: whether their component is more than one star.

    A node is odd that hangs on several others, or on one while others hang on it; what odd nodes hang on, and odd nodes
    themselves, are no roots of finished stars, and of a component of several roots every root is next to an odd node.
    """
    ends = F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")
    nodes = edges.select(*scope, ends).groupBy(*scope, "x.node").agg(F.sum("x.up").alias("up"), F.sum("x.down").alias("down"))
    odd = nodes.filter("up > 1 or (up = 1 and down > 0)").select(*scope, F.col("node").alias("hi"), "down")
    roots = F.explode(F.when(F.col("down") > 0, F.array("hi", "lo")).otherwise(F.array("lo"))).alias("lo")
    unfinished = edges.join(odd, [*scope, "hi"]).select(*scope, roots).distinct().withColumn("open", F.lit(True))
    return edges.join(unfinished, [*scope, "lo"], "left").select(*scope, "hi", "lo", F.coalesce("open", F.lit(False)).alias("open"))


def star_components(pairs: DataFrame, a: str, b: str, scope: list[str] | None = None, max_rounds: int = 100) -> DataFrame:
    """(scope..., node, group): for each node with a link to another one the least node it is tied to, directly or not.

    Pairs with a null end and pairs of a node with itself tie nothing; repeated pairs count once; the ends may be of any
    ordered type; pairs with a null in the scope are left out; an empty input gives no rows. Extra columns are ignored.
    Components that are stars already take no part in further rounds. Each round ends in a stored table, so lost executors
    cost one round at most.
    """
    scope = scope or []
    ends = pairs.select(*scope, F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    ok = ends.filter("_a is not null and _b is not null and _a <> _b")
    edges = (ok.dropna(subset=scope) if scope else ok).select(*scope, "hi", "lo").distinct()
    finished: list[DataFrame] = []
    for _ in range(max_rounds + 1):
        state, (n_open,) = stored_with(_with_open(edges, scope), {"n_open": F.count_if("open")})
        finished.append(state.filter("not open").drop("open"))
        if not n_open:
            break
        edges = _small_star(_large_star(state.filter("open").drop("open"), scope), scope)
    else:
        raise RuntimeError(f"groups still change after {max_rounds} rounds")
    stars = reduce(DataFrame.unionByName, finished)
    roots = stars.select(*scope, F.col("lo").alias("node"), F.col("lo").alias("group")).distinct()
    return stars.select(*scope, F.col("hi").alias("node"), F.col("lo").alias("group")).unionByName(roots)


def component_values(components: DataFrame, values: DataFrame, scope: list[str], node: str, value: str) -> DataFrame:
    """(scope, component, values): the distinct values of all nodes of a component, in order, once for each component and not for each node.

    components: scope, node, group; a node without a component is its own. The transitive walk over links as one
    aggregation; cycles are no matter. Null values are left out; a component without values has no row.
    """
    own = values.filter(F.col(value).isNotNull() & F.col(node).isNotNull()).select(*scope, F.col(node).alias("node"), value)
    placed = own.join(components, [*scope, "node"], "left").select(*scope, F.coalesce("group", "node").alias("component"), value).distinct()
    return placed.groupBy(*scope, "component").agg(F.array_sort(F.collect_list(value)).alias("values"))
