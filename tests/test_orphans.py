"""Orphan references against a plain rule on random rows, and the bitmaps against sets."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from annoloom.operators import orphans
from annoloom.operators.orphans import Bitmap, orphan_references

REFS = "ref_table string, kind int, doc_uid long, element_id long, ref_id long, ingested_at timestamp, reason string"
GOALS = "kind int, doc_uid long, id long, ingested_at timestamp, deleted_at timestamp, ref_id string"
START = datetime(2025, 1, 1)


def run(spark, refs, goals, **kw):
    a = spark.createDataFrame([(*r, "clash") for r in refs], REFS)
    b = spark.createDataFrame([(*g, "clash") for g in goals], GOALS)
    return sorted(map(tuple, orphan_references(a, b, **kw).collect()), key=str)


def plain(refs, goals):
    first, last = {}, {}
    for kind, doc, i, at, gone in goals:
        if i and doc is not None:
            key = (kind, doc, i)
            if at is not None:
                first[key] = min(first.get(key, at), at)
            last[key] = max(last.get(key, (datetime.min, False)), (at or datetime.min, gone is not None))
    seen = defaultdict(list)
    for table, kind, doc, element, ref, at in refs:
        if ref:
            seen[table, kind, doc, element, ref].append(at)
    out = []
    for (table, kind, doc, element, ref), times in seen.items():
        at = min((t for t in times if t is not None), default=None)
        key = (kind, doc, ref)
        reason = "missing" if key not in last else "deleted" if last[key][1] else "late" if at is not None and key in first and first[key] > at else None
        if reason:
            out.append((table, doc, element, ref, at.strftime("%Y-%m") if at else None, reason))
    return sorted(out, key=str)


def at(rng):
    return None if rng.random() < 0.05 else START + timedelta(hours=rng.randrange(3000))


@pytest.mark.parametrize("seed", range(3))
def test_random_rows(spark, seed):
    rng = random.Random(seed)
    goals = [(rng.randrange(3), rng.choice([1, 2, 3, None]), rng.choice([0, None, *range(1, 60)]), at(rng), at(rng) if rng.random() < 0.2 else None) for _ in range(300)]
    refs = [(rng.choice("ab"), rng.choice([0, 1, 2, 2, None]), rng.choice([1, 1, 2, 4, None]), rng.choice([None, *range(40)]), rng.choice([0, None, *range(1, 70)]), at(rng)) for _ in range(400)]
    want = plain(refs + refs[:50], goals + goals[:50])
    assert run(spark, refs + refs[:50], goals + goals[:50]) == want
    assert run(spark, refs, goals, bytes_per_task=2000) == plain(refs, goals)


def test_empty_tables(spark):
    ref = ("a", 0, 1, 1, 5, START)
    assert run(spark, [], []) == []
    assert run(spark, [], [(0, 1, 5, START, None)]) == []
    assert run(spark, [ref], []) == [("a", 1, 1, 5, "2025-01", "missing")]


def test_one_target_cited_by_very_many(spark):
    refs = [("a", 0, 1, i, 5, START) for i in range(5000)]
    assert run(spark, refs, [(0, 1, 5, START, None)], bytes_per_task=1000) == []
    assert len(run(spark, refs, [(0, 1, 5, START + timedelta(1), None)], bytes_per_task=1000)) == 5000


def test_the_bitmaps_decide(spark, monkeypatch):
    """With AND-NOT switched off everything referred to counts as missing: the rows do come through the bitmaps."""
    refs, goals = pa.table(RANGE_REFS), pa.table(RANGE_GOALS)
    assert sorted(zip(*orphans._range(refs, goals).select(["ref_id", "reason"]).to_pydict().values())) == [(6, "deleted"), (7, "late"), (8, "same month"), (9, "missing")]
    monkeypatch.setattr(Bitmap, "and_not", lambda self, other: self)
    assert {r["reason"] for r in orphans._range(refs, goals).to_pylist() if r["ref_id"] == 5} >= {"missing"}


RANGE_REFS = {"ref_table": ["a"] * 5, "kind": pa.array([0] * 5, pa.int32()), "doc_uid": [1] * 5, "ref_id": [5, 6, 7, 8, 9], "month": pa.array([10] * 5, pa.int32()), "first": [100] * 5}
RANGE_GOALS = {"kind": pa.array([0] * 4, pa.int32()), "doc_uid": [1] * 4, "id": [5, 6, 7, 8], "first": [50, 50, 200, 101], "month": pa.array([10, 10, 11, 10], pa.int32()), "deleted": [False, True, False, False]}


codes = st.one_of(st.lists(st.integers(0, 300_000), max_size=60), st.builds(lambda a, n, s: list(range(a, a + n * s, s)), st.integers(0, 70_000), st.integers(0, 9000), st.integers(1, 3)))


@settings(max_examples=60, deadline=None)
@given(codes, codes)
def test_bitmaps(a, b):
    x, y = Bitmap.of(np.array(a, np.int64)), Bitmap.of(np.array(b, np.int64))
    assert x.decode().tolist() == sorted(set(a))
    assert x.and_not(y).decode().tolist() == sorted(set(a) - set(b))
    assert x.both(y).decode().tolist() == sorted(set(a) & set(b))
    assert x.union(y).decode().tolist() == sorted(set(a) | set(b))
