"""References to records that do not exist, by compressed bitmaps over dictionary-encoded keys.

Keys (kind, doc_uid, id) fall into key ranges: 4096 neighbouring ids of one document make a block, blocks are spread over
ranges by hash, so that a huge document makes no large task. References come to a range as distinct keys per table and
month, however many references a key has: a much-cited target is one row a month there. Inside a range the keys become
dense integers, and bitmaps decide: referred AND-NOT known is missing, (referred AND known) AND-NOT live is deleted,
(referred AND live) AND-NOT those that arrived in earlier months, AND-NOT those of the same month, is late. What remains of
the same month is sent back with the target's time, as a month can't order it. The surviving keys are decoded and joined
with the single references, a join that splits a hot key as skewed joins do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import size_of, shards

CHUNK, DENSE = 1 << 16, 4096


class Bitmap:
    """Sorted integers in chunks of 65,536: up to 4,096 as sorted offsets, more as packed bits."""

    def __init__(self, chunks: dict[int, np.ndarray]) -> None:
        self.chunks = chunks

    @classmethod
    def of(cls, codes: np.ndarray) -> Bitmap:
        codes = np.unique(codes)
        high = codes // CHUNK
        starts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(codes) else np.empty(0, int)
        return cls({int(high[a]): cls._pack((codes[a:b] % CHUNK).astype(np.uint16)) for a, b in zip(starts, [*starts[1:], len(codes)])})

    @staticmethod
    def _pack(low: np.ndarray) -> np.ndarray:
        if len(low) <= DENSE:
            return low
        bits = np.zeros(CHUNK, bool)
        bits[low] = True
        return np.packbits(bits)

    @staticmethod
    def _low(chunk: np.ndarray) -> np.ndarray:
        return chunk if chunk.dtype == np.uint16 else np.flatnonzero(np.unpackbits(chunk)).astype(np.uint16)

    @staticmethod
    def _bits(chunk: np.ndarray) -> np.ndarray:
        if chunk.dtype == np.uint8:
            return chunk
        bits = np.zeros(CHUNK, bool)
        bits[chunk] = True
        return np.packbits(bits)

    def and_not(self, other: Bitmap) -> Bitmap:
        out = {}
        for k, x in self.chunks.items():
            y = other.chunks.get(k)
            if y is not None:
                if x.dtype == np.uint8:
                    x = self._pack(self._low(x & ~self._bits(y)))
                elif y.dtype == np.uint8:
                    x = x[(y[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 == 0]
                else:
                    x = np.setdiff1d(x, y, assume_unique=True)
            if len(x):
                out[k] = x
        return Bitmap(out)

    def both(self, other: Bitmap) -> Bitmap:
        return self.and_not(self.and_not(other))

    def union(self, other: Bitmap) -> Bitmap:
        out = dict(self.chunks)
        for k, y in other.chunks.items():
            x = out.get(k)
            if x is None:
                out[k] = y
            elif x.dtype == y.dtype == np.uint16 and len(x) + len(y) <= DENSE:
                out[k] = np.union1d(x, y)
            else:
                out[k] = self._pack(self._low(self._bits(x) | self._bits(y)))
        return Bitmap(out)

    def decode(self) -> np.ndarray:
        return np.concatenate([k * CHUNK + self._low(x).astype(np.int64) for k, x in sorted(self.chunks.items())] or [np.empty(0, np.int64)])


NONE = Bitmap({})
NO_KIND = np.iinfo(np.int32).min
EARLY, LATE = np.iinfo(np.int64).min, np.iinfo(np.int64).max
MISSING, DELETED, ORPHAN_LATE, SAME_MONTH = "missing", "deleted", "late", "same month"
_OUT = pa.schema([("ref_table", pa.string()), ("kind", pa.int32()), ("doc_uid", pa.int64()), ("ref_id", pa.int64()), ("month", pa.int32()), ("reason", pa.string()), ("target_first", pa.int64())])
_DDL = "ref_table string, kind int, doc_uid long, ref_id long, month int, reason string, target_first long"


def _codes(columns: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, int]:
    """The dictionary: rows of two tables with equal keys get the same dense integer, in key order."""
    n = len(columns[0][0])
    joint = [np.concatenate(pair) for pair in columns]
    order = np.lexsort(joint[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in joint], axis=0)
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    return code[:n], code[n:], int(new.sum())


def _range(refs: pa.Table, targets: pa.Table) -> pa.Table:
    """One key range. refs: ref_table, kind, doc_uid, ref_id, month (since year 0, null unknown), first, the least of the key's references, one row each key, table and month;
    targets: kind, doc_uid, id, first, month, deleted, one row each key."""
    if not refs.num_rows:
        return _OUT.empty_table()
    num = lambda t, c, null: t[c].fill_null(null).to_numpy()
    ref, target, size = _codes([(num(refs, a, NO_KIND), num(targets, b, NO_KIND)) for a, b in (("kind", "kind"), ("doc_uid", "doc_uid"), ("ref_id", "id"))])
    month, gone = num(targets, "month", 0), num(targets, "deleted", False)
    known, live = Bitmap.of(target), Bitmap.of(target[~gone])
    by_month = {int(m): Bitmap.of(target[~gone & (month == m)]) for m in np.unique(month)}
    target_at = np.full(size, -1)  # the row of a code's target, to read its time where months are equal
    target_at[target] = np.arange(len(target))
    target_first = num(targets, "first", EARLY)

    ref_first, ref_month = num(refs, "first", LATE), num(refs, "month", 1 << 20)
    names = refs["ref_table"].fill_null("").combine_chunks().dictionary_encode()
    table = names.indices.to_numpy()
    row_at = np.empty(size, np.int64)  # the row of a code within the table and month at hand
    found: list[tuple[np.ndarray, str]] = []
    before, waiting = NONE, sorted(by_month)
    for m in np.unique(ref_month):
        while waiting and waiting[0] < m:
            before = before.union(by_month[waiting.pop(0)])
        for t in range(len(names.dictionary)):
            rows = np.flatnonzero((ref_month == m) & (table == t))
            row_at[ref[rows]] = rows
            referred = Bitmap.of(ref[rows])
            not_yet = referred.both(live).and_not(before)
            late = not_yet.and_not(by_month.get(int(m), NONE))
            for bits, reason in ((referred.and_not(known), MISSING), (referred.both(known).and_not(live), DELETED), (late, ORPHAN_LATE), (not_yet.and_not(late), SAME_MONTH)):
                found.append((row_at[bits.decode()], reason))
    rows = np.concatenate([r for r, _ in found])
    reason = np.concatenate([np.full(len(r), name, object) for r, name in found])
    same = reason == SAME_MONTH
    first = np.full(len(rows), EARLY)
    first[same] = target_first[target_at[ref[rows[same]]]]
    keep = ~same | (first > ref_first[rows])  # nothing of a key is late that arrived before the least of its references
    out = refs.take(pa.array(rows[keep]))
    return pa.table([*(out[c] for c in ("ref_table", "kind", "doc_uid", "ref_id", "month")), pa.array(reason[keep], pa.string()), pa.array(first[keep])], schema=_OUT)


def _months(ts: str) -> F.Column:
    return F.year(ts) * 12 + F.month(ts)


def _spread(doc: str, key: str, ranges: int) -> F.Column:
    return F.pmod(F.xxhash64("kind", doc, F.shiftright(F.col(key), 12)), F.lit(ranges)).cast("int")


def orphan_references(references: DataFrame, targets: DataFrame, bytes_per_task: int = 256 << 20) -> DataFrame:
    """References without a live target that was there in time: (ref_table, doc_uid, element_id, ref_id, arrival_month, reason).

    references: ref_table, kind int, doc_uid, element_id, ref_id, ingested_at; targets: kind int, doc_uid, id, ingested_at,
    deleted_at. Rows delivered again are one reference or target: its first ingested_at is its arrival, its latest row
    says whether it is deleted (of several latest ones any). Null and 0 ids refer to nothing and are no targets. A
    reference with a null doc_uid or kind is missing its target. A null ingested_at is no arrival: such a target is never late,
    such a reference has a null month and is never too early. Each kept reference comes once, with one reason: missing,
    deleted or late. Other columns are ignored; empty tables give no rows. bytes_per_task: of the inputs as the plan's
    statistics know them; it sets the number of tasks, at least the session's, each with eight key ranges or so, not the
    result.
    """
    refs = (
        references.filter("ref_id <> 0")
        .groupBy("ref_table", "kind", "doc_uid", "element_id", "ref_id")
        .agg(F.min("ingested_at").alias("ts"))
        .select("ref_table", "kind", "doc_uid", "element_id", "ref_id", F.date_format("ts", "yyyy-MM").alias("arrival_month"), _months("ts").cast("int").alias("month"), F.unix_micros(F.col("ts").cast("timestamp")).alias("first"))
    )
    goals = (
        targets.filter("id <> 0 and doc_uid is not null and kind is not null")
        .groupBy("kind", "doc_uid", "id")
        .agg(F.min("ingested_at").alias("ts"), F.max(F.struct(F.col("ingested_at"), F.col("deleted_at").isNotNull().alias("deleted"))).alias("last"))
        .select("kind", "doc_uid", "id", _months("ts").cast("int").alias("month"), F.unix_micros(F.col("ts").cast("timestamp")).alias("first"), F.col("last.deleted").alias("deleted"))
    )
    tasks = shards(size_of(references) + size_of(targets), bytes_per_task, int(references.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = 8 * tasks
    homeless = refs.filter("doc_uid is null").select("ref_table", "doc_uid", "element_id", "ref_id", "arrival_month", F.lit(MISSING).alias("reason"))
    housed = refs.filter("doc_uid is not null")
    key = ["ref_table", "kind", "doc_uid", "ref_id", "month"]
    left = housed.groupBy(*key).agg(F.min("first").alias("first")).withColumn("key_range", _spread("doc_uid", "ref_id", ranges)).repartition(tasks, "key_range")
    right = goals.withColumn("key_range", _spread("doc_uid", "id", ranges)).repartition(tasks, "key_range")
    decided = left.groupBy("key_range").cogroup(right.groupBy("key_range")).applyInArrow(lambda a, b: _range(a, b), _DDL)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"d.{c}")) if c in ("ref_table", "kind", "month") else F.col(f"r.{c}") == F.col(f"d.{c}") for c in key]
    joined = housed.alias("r").join(decided.alias("d"), same).filter((F.col("d.reason") != SAME_MONTH) | (F.col("r.first") < F.col("d.target_first")))
    reason = F.when(F.col("d.reason") == SAME_MONTH, ORPHAN_LATE).otherwise(F.col("d.reason")).alias("reason")
    return joined.select("r.ref_table", "r.doc_uid", "r.element_id", "r.ref_id", "r.arrival_month", reason).unionByName(homeless)
