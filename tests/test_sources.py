"""Sources and sinks by round trip, XMI in plain files and zips, event streams against plain windows."""

import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from annoloom.operators import graph
from annoloom.plans.source_queries import XMI
from annoloom.sources import files, project, xmi
from annoloom.streaming import events


def test_xmi_from_files_and_zips(spark, tmp_path):
    folder = tmp_path / "a" / "abcd01_one-two.txt"
    folder.mkdir(parents=True)
    (folder / "anno_01.xmi").write_text(XMI)
    with zipfile.ZipFile(folder / "export.zip", "w") as z:
        z.writestr("anno_02.xmi", XMI)
        z.writestr("typesystem.xml", "<x/>")
    (folder / "broken.zip").write_bytes(b"no zip")
    docs = xmi.parse(xmi.read_files(spark, str(tmp_path)))
    assert sorted(r.annotator_id for r in docs.collect()) == ["anno_01", "anno_02"]
    assert {r.document_id for r in docs.collect()} == {"abcd01"}
    assert [tuple(r)[1:5] for r in xmi.counts(docs).collect()] == [(3, 2, 2, 3)] * 2
    units = {(r.event_id, r.link_id, r.element_id) for r in xmi.event_units(docs, "participant").collect()}
    assert units == {(20, 31, 25), (20, 32, 26), (21, 33, 26)}
    assert xmi.units(docs, "discontiguous").first().link_id == 35 and xmi.sentiments(docs).count() == 2
    assert [(r.governor, r.dependent) for r in xmi.pairs(docs, "custom:CorefEvent").distinct().collect()] == [(21, 20)] * 2
    assert {(r.element_id, r.role) for r in xmi.units(docs, "sentiment_target").collect()} == {(26, "Thing"), (27, "sentiment_target")}
    assert [r.event_fulltype for r in xmi.units(docs, "sentiment_event").collect()] == ["Growth.None"] * 2
    odd = xmi.parse(spark.createDataFrame([("p", "m.xmi", "<no"), ("p", "n.xmi", None)], "path string, member string, content string"))
    assert [r.text for r in odd.collect()] == [None, None] and xmi.events(odd).count() == 0


def test_project(spark, tmp_path):
    folder = tmp_path / "annotation" / "abcd01_one-two.txt"
    folder.mkdir(parents=True)
    with zipfile.ZipFile(folder / "b.zip", "w") as z:
        z.writestr("anno_02.xmi", XMI)
        z.writestr("typesystem.xml", "<second/>")
    with zipfile.ZipFile(folder / "a.zip", "w") as z:
        z.writestr("anno_01.xmi", XMI)
        z.writestr("typesystem.xml", "<first/>")
    listed = [{"name": "t1", "user": "anno_01", "state": "X"}, {"name": "t1", "user": "anno_02"}, {"name": "t2", "user": None}]
    (tmp_path / "exportedproject7.json").write_text(json.dumps({"name": "p", "annotation_documents": listed}))
    opened = project.open_project(spark, str(tmp_path))
    assert opened.documents.count() == 2 and project.type_system(spark, str(tmp_path)).first().content == "<first/>"
    assert {tuple(r) for r in project.listed_documents(opened).collect()} == {("t1", "anno_01"), ("t1", "anno_02"), ("t2", None)}
    kept = spark.createDataFrame([("t1", "anno_02"), ("t9", "x")], "title string, annotator string")
    assert [[d.user for d in r.annotation_documents] for r in project.cleaned_metadata(opened, kept).collect()] == [["anno_02"]]
    assert [r.member for r in project.members_of(opened.members, "anno_01").collect()] == ["anno_01.xmi"]
    with pytest.raises(ValueError):
        project.open_project(spark, str(tmp_path), "pdf")
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "x.txt").write_text("")
    assert project.open_project(spark, str(empty)).metadata.count() == 0 and project.type_system(spark, str(empty)).count() == 0
    table = tmp_path / "companies.tsv"
    table.write_text("security\tindustry\tsubindustry\tcorpussymbol\ttickersymbol\tallinfo\nAcme\tX\tY\tACM\tACME\t-\n")
    assert project.companies(spark, str(table)).first().symbol == "acm"


def test_flat_files(spark, tmp_path):
    types = tmp_path / "typology.json"
    types.write_text(json.dumps([{"full_name": "A.b", "maintype_name": "A", "subtype_name": None, "participant": [{"name": "X", "on_type": True, "on_subtype": False, "is_target": True}], "filler": None}]))
    assert files.typology(spark, str(types)).first().participant[0].name == "X"
    roles = tmp_path / "roles.json"
    roles.write_text(json.dumps({"New": ["old", "older"], "Same": ["Same"]}))
    df = spark.createDataFrame([("old",), ("Same",), ("else",), (None,)], "role string")
    assert sorted((str(r.role) for r in files.renamed_roles(df, files.role_map(spark, str(roles)), "role").collect())) == ["New", "None", "Same", "else"]
    files.write_delimited(spark.createDataFrame([("a", None), ("b", "x\ty")], "k string, v string"), str(tmp_path / "out"), sep="\t")
    assert {tuple(r) for r in files.delimited(spark, str(tmp_path / "out"), "k string, v string").collect()} == {("a", None), ("b", "x\ty")}
    docs = spark.createDataFrame([("train", '{"doc_key": "1"}'), ("dev", '{"doc_key": "2"}')], "split string, doc string")
    files.write_json_lines(docs, str(tmp_path / "json"), "doc", ["split"])
    assert {(r.split, r.doc_key) for r in spark.read.json(str(tmp_path / "json")).collect()} == {("train", "1"), ("dev", "2")}
    one = files.fingerprint(spark, str(tmp_path / "json")).first()[0]
    assert one == files.fingerprint(spark, str(tmp_path / "json")).first()[0] != files.fingerprint(spark, str(tmp_path / "out")).first()[0]
    assert {(r.split, r.doc) for r in files.split_ids(docs.union(docs), "split", "doc").collect()} == {("train", '{"doc_key": "1"}'), ("dev", '{"doc_key": "2"}')}
    spans = tmp_path / "spans.tsv"
    spans.write_text("id\tevent_type\tspan-pos\n1\tA\t['NOUN', 'VERB']\n2\tB\t[broken\n3\tC\t\n")
    assert [(r.id, r["span-pos"]) for r in files.span_table(spark, str(spans), ["id", "event_type", "span-pos"], ["span-pos"]).collect()] == [("1", ["NOUN", "VERB"]), ("2", None), ("3", None)]
    made = []
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "cache"), "stage", one, lambda: made.append(1) or docs).count() == 2
    assert made == [1]
    text = spark.createDataFrame([("a grew a", "grew"), ("a", "z")], "t string, p string")
    assert [r[0] for r in text.select(files.marked("t", "p", "<", ">")).collect()] == ["a <grew> a", "a"]


def test_streams(spark, tmp_path):
    start = datetime(2025, 1, 1)
    rows = [(i % 3, start + timedelta(minutes=7 * i), i // 2) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, id int")
    df.write.parquet(str(tmp_path / "in"))
    for name, f in (("w", lambda d: events.windowed_counts(d, "ts", ["k"], "1 hour", "1 day")), ("s", lambda d: events.sessions(d, "ts", ["k"], "30 minutes", "1 day")), ("c", lambda d: events.without_copies(d, "ts", ["id"], "1 day"))):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        query = f(stream).writeStream.format("memory").queryName(f"q_{name}").outputMode("append" if name == "c" else "complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        got = spark.table(f"q_{name}")
        if name == "c":
            assert got.count() == 30
        else:
            assert got.agg(F.sum("n")).first()[0] == 60 and sorted(map(str, got.collect())) == sorted(map(str, f(df).collect()))


def test_component_values(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 7, 8)], "s int, a int, b int")
    values = spark.createDataFrame([(1, 1, "x"), (1, 3, "y"), (1, 8, None), (1, 9, "z")], "s int, n int, v string")
    out = graph.component_values(graph.star_components(edges, "a", "b", ["s"]), values, ["s"], "n", "v")
    assert {r.component: r["values"] for r in out.collect()} == {1: ["x", "y"], 9: ["z"]}
