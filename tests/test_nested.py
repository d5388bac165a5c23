"""Nested records: every shape a container may have, broken input, and an exact round trip of random documents."""

import json
import random

from annoloom.operators.nested import TABLES, decoded_records, flatten_decoded, flatten_records

SCHEMA = "record_id long, payload string, doc_uid string, layer string"  # the last two clash with output names


def flat(spark, payloads, table="children"):
    rows = [(i, p if p is None or isinstance(p, str) else json.dumps(p), "x", "y") for i, p in enumerate(payloads)]
    return flatten_records(spark.createDataFrame(rows, SCHEMA), table)


def found(spark, payloads):
    return {(r.doc_uid, r.event_id, r.layer, r.link_id, r.element_id) for r in flat(spark, payloads).collect()}


def event(**kw):
    return {"element_id": 5, "type": "T"} | kw


def test_shapes_of_a_container(spark):
    child = {"link_id": "8", "element": {"element_id": 7, "begin": 1, "end": 3}}
    flat_child = {"linkId": 9, "element_id": "6"}
    shapes = [[child, flat_child], [[child], [[flat_child]]], {"count": 2, "items": [child, flat_child]}, {"8": {"element": {"element_id": 7}}, "9": {"element_id": 6}}, json.dumps([child, flat_child])]
    for shape in shapes:
        for holder in ({"fillers": shape}, {"args": {"fillers": shape}}):
            assert found(spark, [{"doc_uid": "1", "events": [event(**holder)]}]) == {(1, 5, "filler", 8, 7), (1, 5, "filler", 9, 6)}, shape
    assert found(spark, [{"doc_uid": 1, "events": [event(discontiguous=child, fillers=None)]}]) == {(1, 5, "discontiguous", 8, 7)}


def test_ids_that_name_nothing(spark):
    kids = [{"link_id": x, "element_id": 3} for x in (None, 0, "0", "", "x", True, 1.5)] + [{"element_id": 3}]
    assert {link for *_, link, _ in found(spark, [{"doc_uid": 1, "events": [event(fillers=kids)]}])} == {None}
    assert found(spark, [{"doc_uid": 1, "events": [event(fillers={"_12": {"element_id": 3}})]}]) == {(1, 5, "filler", None, 3)}


def test_where_documents_and_events_stand(spark):
    e = event(fillers=[{"link_id": 8, "element_id": 7}])
    want = {(1, 5, "filler", 8, 7)}
    for doc in ({"events": [e]}, {"sentences": [{"events": [e]}]}, {"paragraphs": [{"sentences": [{"events": [e]}]}]}, {"annotation": json.dumps({"events": [e]})}):
        doc = {"doc_uid": 1} | doc
        for payload in (doc, [doc], {"export": {"documents": [doc]}}):
            assert found(spark, [payload]) == want, payload


def test_inner_events_and_earlier_versions(spark):
    inner = {"element_id": 6, "fillers": [{"link_id": 2, "element_id": 3}], "coordination": [{"element_id": 9, "args": {"discontiguous": {"link_id": 4, "element_id": 1}}}]}
    outer = event(coordination=[inner], previous_versions=[{"fillers": [{"link_id": 77, "element_id": 76}], "events": [event(fillers=[{"link_id": 78, "element_id": 1}])]}])
    payload = {"doc_uid": 1, "events": [outer]}
    assert found(spark, [payload]) == {(1, 6, "filler", 2, 3), (1, 9, "discontiguous", 4, 1)}
    rows = {r.event_id: (r.event_no, r.parent_event_no) for r in flat(spark, [payload], "events").collect()}
    assert rows == {5: (0, None), 6: (1, 0), 9: (2, 1)}


def test_broken_null_empty_and_deep(spark):
    deep = "[" * 100_000 + "]" * 100_000
    for table in TABLES:
        assert flat(spark, [None, "", "  ", "{", '{"doc_uid": 1, "events": [', "3", '"x"', "[]", "null", deep], table).count() == 0
        assert flatten_records(spark.createDataFrame([], SCHEMA), table).count() == 0
    assert [r.doc_uid for r in flat(spark, [{"events": []}, {"doc_uid": None, "events": None}], "documents").collect()] == [None, None]


def test_long_text_and_repeats(spark):
    doc = {"doc_uid": 1, "events": [event(text="x" * 3_000_000, fillers=[{"link_id": 8, "element_id": 7}])]}
    assert flat(spark, [doc, doc]).count() == 2
    assert {len(r.text) for r in flat(spark, [doc], "events").collect()} == {3_000_000}


def test_round_trip(spark):
    rng, docs, want = random.Random(3), [], set()
    for uid in range(1, 60):
        events = []
        for e in range(rng.randrange(4)):
            kids = [(rng.choice(["fillers", "discontiguous", "participants"]), rng.randrange(1, 999), rng.randrange(1, 999)) for _ in range(rng.randrange(5))]
            node = {"element_id": 1000 + e}
            for name, link, element in kids:
                node.setdefault(name, []).append({"link_id": link, "element_id": element})
                want.add((uid, 1000 + e, {"fillers": "filler", "participants": "participant"}.get(name, name), link, element))
            events.append(node)
        docs.append({"doc_uid": uid, "events": events})
    assert found(spark, [docs[:20], *docs[20:]]) == want


def test_ids_beyond_18_digits_keep_their_links(spark):
    kids = [{"link_id": str((1 << 63) - 1), "element_id": (1 << 63) - 1}, {"link_id": "1234567890123456789", "element_id": 1.0}, {"link_id": str(1 << 63), "element_id": "000000000000000000000007"}]
    assert found(spark, [{"doc_uid": 1, "events": [event(fillers=kids)]}]) == {(1, 5, "filler", (1 << 63) - 1, (1 << 63) - 1), (1, 5, "filler", 1234567890123456789, 1), (1, 5, "filler", None, 7)}


def test_constants_outside_json_break_a_payload(spark):
    good = '{"doc_uid": 1, "events": [{"element_id": 5, "fillers": [{"link_id": 8, "element_id": 7}]}]}'
    assert flat(spark, [good.replace("5,", f"{x},") for x in ("NaN", "Infinity", "-Infinity", "01", "+1")]).count() == 0
    assert flat(spark, [good]).count() == 1


def test_nesting_has_no_limit(spark):
    inner = '{"element_id": 6, "fillers": [{"link_id": 8, "element_id": 7}]}'
    deep = '{"doc_uid": 1, "events": [' + '{"element_id": 5, "coordination": [' * 20_000 + inner + "]}" * 20_000 + "]}"
    assert found(spark, [deep]) == {(1, 6, "filler", 8, 7)}
    assert found(spark, [json.dumps({"doc_uid": 1, "annotation": "[" * 20_000, "events": [event(fillers={"link_id": 8, "element_id": 7})]})]) == {(1, 5, "filler", 8, 7)}


def test_text_inside_text(spark):
    doc = {"doc_uid": 1, "annotation": json.dumps({"a": json.dumps({"events": json.dumps([event(text='{"events": 1}', fillers={"link_id": 8, "element_id": 7})])})})}
    assert found(spark, [doc]) == {(1, 5, "filler", 8, 7)}
    assert [r.text for r in flat(spark, [doc], "events").collect()] == ['{"events": 1}']


def test_all_tables_from_one_decoding(spark):
    docs = [{"doc_uid": i, "metadata": {"document_title": f"t{i}"}, "events": [event(participants=[{"link_id": 1, "element_id": i, "canonical_referents": [{"pronom_id": i, "referent_id": 9}]}])]} for i in range(1, 40)]
    rows = spark.createDataFrame([(i, json.dumps(d), "x", "y") for i, d in enumerate(docs)], SCHEMA)
    decoded = decoded_records(rows)
    for table in TABLES:
        assert sorted(flatten_decoded(decoded, table).collect()) == sorted(flatten_records(rows, table).collect())
        assert flatten_decoded(decoded, table).count() == 39
