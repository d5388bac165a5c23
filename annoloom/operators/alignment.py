"""Alignment of several annotators' units by interval unions, and the resolution of an annotator's own overlaps."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spans import interval_union


def unit_groups(spans: DataFrame) -> DataFrame:
    """spans with group_no of the union of all annotators' overlapping units in a document, and self_overlap, whether some annotator has more than one in it."""
    grouped = interval_union(spans.withColumn("_end", F.col("last") + 1), ["doc_id"], "first", "_end", order=("annotator", "span_id")).drop("_end", "group_begin", "group_end")
    own = F.count("*").over(Window.partitionBy("doc_id", "group_no", "annotator"))
    return grouped.withColumn("own", own).withColumn("self_overlap", F.max("own").over(Window.partitionBy("doc_id", "group_no")) > 1).drop("own")


def _dice(a: tuple[int, int], b: tuple[int, int]) -> float:
    shared = min(a[1], b[1]) - max(a[0], b[0]) + 1
    return 2 * shared / (a[1] - a[0] + b[1] - b[0] + 2) if shared > 0 else 0.0


def resolve_group(units: list[tuple[int, int, int, int, str]]) -> list[int]:
    """Units (first, last, annotator, span_id, label), in order, of one group in which an annotator overlaps with himself or herself; gives every unit its part of the group.

    Between each two annotators only the cells of greatest dice tie units, if all cells are equal only those of one label;
    tied units form a part; of an annotator's several units in a part the one of greatest mean dice to the others stays
    (the first on ties), the rest are parts of their own. Parts are numbered from 1 in order of their first unit.
    """
    span, who, label = [u[:2] for u in units], [u[2] for u in units], [u[4] for u in units]
    parent = list(range(len(units)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    of: dict[int, list[int]] = {}
    for i, a in enumerate(who):
        of.setdefault(a, []).append(i)
    names = sorted(of)
    for n, a in enumerate(names):
        for b in names[n + 1 :]:
            cells = [(_dice(span[i], span[j]), i, j) for i in of[a] for j in of[b]]
            top, low = max(c[0] for c in cells), min(c[0] for c in cells)
            for d, i, j in cells:
                if d == top > 0 and (len(cells) == 1 or top > low or label[i] == label[j]):
                    i, j = sorted((root(i), root(j)))
                    parent[j] = i
    part = [root(i) for i in range(len(units))]
    members: dict[int, list[int]] = {}
    for i, p in enumerate(part):
        members.setdefault(p, []).append(i)
    for own_part in members.values():
        for a in {who[i] for i in own_part}:
            own, others = [i for i in own_part if who[i] == a], [i for i in own_part if who[i] != a]
            if len(own) > 1:
                best = max(own, key=lambda i: (sum(_dice(span[i], span[j]) for j in others) / max(1, len(others)), -i))
                for i in own:
                    if i != best:
                        part[i] = len(units) + i
    order = {p: k + 1 for k, p in enumerate(dict.fromkeys(part))}
    return [order[p] for p in part]


_OUT = pa.schema([("doc_id", pa.int64()), ("group_no", pa.int64()), ("annotator", pa.int32()), ("span_id", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("label", pa.string()), ("part_no", pa.int64())])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups come whole and in order, possibly over a batch's end; one group is held at a time."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    out: list[list] = [[] for _ in _OUT]
    for (doc, no), group in groupby(rows(), key=lambda r: r[:2]):
        units = [(first, last, a, i, label) for _, _, first, last, a, i, label in group]
        for (first, last, a, i, label), part in zip(units, resolve_group(units)):
            for col, x in zip(out, (doc, no, a, i, first, last, label, part)):
                col.append(x)
        if len(out[0]) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _OUT)], schema=_OUT)
            out = [[] for _ in _OUT]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _OUT)], schema=_OUT)


def resolved_groups(spans: DataFrame) -> DataFrame:
    """(doc_id, annotator, span_id, first, last, label, group_id): groups without self-overlap as they are, others in parts '<group>_<part>'.

    Only flagged groups go to Python, in Arrow batches of many groups; a group is a run of overlapping units inside one document.
    """
    grouped = unit_groups(spans).select("doc_id", "group_no", "first", "last", "annotator", "span_id", "label", "self_overlap")
    flagged = grouped.filter("self_overlap").drop("self_overlap").repartition("doc_id", "group_no")
    order = ["doc_id", "group_no", "first", "last", "annotator", "span_id"]
    split = flagged.sortWithinPartitions(*order).mapInArrow(_resolve, "doc_id long, group_no long, annotator int, span_id int, first int, last int, label string, part_no long")
    both = grouped.filter("not self_overlap").drop("self_overlap").withColumn("part_no", F.lit(None).cast("long")).unionByName(split)
    return both.select("doc_id", "annotator", "span_id", "first", "last", "label", F.concat_ws("_", "doc_id", "group_no", "part_no").alias("group_id"))


def alignment_matrix(spans: DataFrame, annotators: list[int], missing: str | None = None) -> DataFrame:
    """One row for each resolved group, one column of labels for each annotator; blank ones null or `missing`."""
    wide = resolved_groups(spans).groupBy("group_id").pivot("annotator", annotators).agg(F.first("label"))
    named = wide.select("group_id", *(F.col(str(a)).alias(f"annotator_{a}") for a in annotators))
    return named.na.fill(missing) if missing is not None else named
