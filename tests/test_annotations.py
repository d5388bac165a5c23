"""Extents, pipelines, studies, copies and checks at their edges: nulls, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from annoloom.operators import checks, extents, pipelines, selection, study

UNITS = "doc_uid long, element_id long, layer string, first int, last int, sent_idx int, tok_idx string, home string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([(1, i, i // 5, f"w{i}", "PRP" if i in (2, 3) else "NN") for i in range(20)], "doc_uid long, tok_idx int, sent_idx int, tok string, tag string")


def test_extents(spark, grid):
    units = frame(spark, UNITS, (1, 7, "event", 1, 2, 0, "x", "x"), (1, 8, "event", None, 3, None, "x", "x"), (1, 9, "event", 4, 2, None, "x", "x"), (2, 7, "event", 0, 1, 0, "x", "x"))
    parts = frame(spark, UNITS, (1, 7, "discontiguous", 2, 3, 0, "x", "x"), (1, 7, "discontiguous", 2, 3, 0, "x", "x"), (1, 7, "discontiguous", 4, 6, None, "x", "x"), (1, 7, "filler", 0, 0, 0, "x", "x"), (5, 5, "filler", 0, 0, 0, "x", "x"))
    text = lambda **kw: rows(extents.extent_text(extents.extent_tokens(units, parts, grid, **kw)).select("doc_uid", "element_id", "text"))
    assert text(layers=["discontiguous"]) == [(1, 7, "w1 w2 w3 w4")]
    assert text(layers=["discontiguous"], same_sentence=False) == [(1, 7, "w1 w2 w3 w4 w5 w6")]
    assert text(layers=[]) == [(1, 7, "w1 w2")] and text(layers=["filler", "nothing"]) == [(1, 7, "w0 w1 w2")]
    assert extents.extent_tokens(units.limit(0), parts, grid, ["filler"]).count() == 0
    owners = frame(spark, "doc_uid long, element_id long, event_id long", (1, 3, 9), (1, 3, 8), (1, 3, 8), (1, 4, None))
    assert [(r.element_id, r.owners, r.n_owners) for r in extents.containers(owners).collect()] == [(3, [8, 9], 2)]
    rated = extents.token_ratings(grid, units.withColumn("label", F.col("layer")), {"e": ["event"], "f": ["filler"]})
    assert rows(rated.filter("tok_idx in (1, 3)").select("tok_idx", "e", "f", "labels")) == [(1, 1, -1, "event"), (3, -1, -1, "-1")]


def test_targets(spark, grid):
    units = frame(spark, "doc_uid long, unit_id long, sent_idx int", (1, 1, 0), (1, 2, 1), (1, 3, None))
    schema = "doc_uid long, unit_id long, target_id long, first int, last int, sent_idx int"
    targets = frame(spark, schema, (1, 1, 10, 0, 1, 0), (1, 1, 11, 2, 3, 0), (1, 2, 10, 0, 1, 0), (1, 3, 12, 4, 5, None))
    spots = frame(spark, UNITS, (1, 10, "p", 0, 1, 0, "", ""), (1, 11, "p", 2, 3, 0, "", ""), (1, 12, "p", 4, 5, None, "", ""), (1, 13, "p", 4, 4, 0, "", ""), (1, 14, "p", 9, 9, 1, "", ""))
    refs = frame(spark, "doc_uid long, element_id long, referent_id long", (1, 10, 13), (1, 10, 13), (1, 10, 14), (1, 11, 99), (1, None, 13))
    names = lambda df: sorted((r.unit_id, r.target_id) for r in df.collect())
    assert names(pipelines.replaced_targets(targets, refs, spots)) == [(1, 11), (1, 13), (1, 14), (2, 13), (2, 14), (3, 12)]
    assert names(pipelines.replaced_targets(targets, refs, spots, same_sentence=True)) == [(1, 11), (1, 13), (2, 13), (3, 12)]
    assert names(pipelines.extended_targets(targets, refs, spots, 5)) == [(1, 10), (1, 11), (1, 13), (2, 10), (2, 13), (3, 12)]
    assert names(pipelines.extended_targets(targets, refs, spots, 4)) == [(1, 10), (1, 11), (2, 10), (3, 12)]
    elsewhere = refs.filter("referent_id = 14")
    assert names(pipelines.replaced_targets(targets, elsewhere, spots, same_sentence=True)) == [(1, 11), (3, 12)]  # 10's only referent stands elsewhere
    assert names(pipelines.targets_in_sentence(units, targets)) == [(1, 10), (1, 11)]
    pronouns = pipelines.pronominal_spans(spots, grid, ("PRP",))
    assert rows(pronouns) == [(1, 11)]
    left, kept = pipelines.prepare(units, targets, refs, spots, pronouns)
    assert names(kept) == [(1, 13)] and [r.unit_id for r in left.collect()] == [1]
    assert pipelines.prepare(units, targets, keep_bare_units=True)[0].count() == 3
    assert rows(pipelines.loss(targets, kept, "s")) == [("s", 4, 1, 3, 75.0)] and rows(pipelines.loss(targets.limit(0), kept.limit(0), "s")) == [("s", 0, 0, 0, None)]
    assert [r.unit_id for r in pipelines.without_units(units, targets.filter("unit_id < 3")).collect()] == [3]


def test_studies(spark):
    docs = frame(spark, "title string, annotator string, ref_annotator string", ("t", "a", "x"), ("t", "b", "x"), ("u", "a", "x"), ("t", "a", "x"), (None, "a", "x"), ("t", None, "x"))
    assert rows(study.ordered_pairs(docs)) == [("t", "a", "b"), ("t", "b", "a")]
    assert rows(study.titles_by_annotator(docs)) == [("a", 2, 0), ("b", 1, 1)] and not study.same_titles(docs) and study.same_titles(docs.filter("title = 't'"))
    spans = frame(spark, "doc_id long, annotator int, span_id int, first int, last int, label string", (1, 0, 5, 0, 3, "x"), (1, 0, 6, 8, 9, "y"), (1, 1, 5, 1, 3, "x"), (2, 1, 7, 0, 0, "x"))
    found = study.matches_of(spans, [0, 1])
    assert rows(study.match_counts(spans, found)) == [(0, 1, 2, 1, 50.0), (1, 0, 1, 1, 100.0)]
    assert [(r.n_gold, r.n_gold_mapped, r.n_system, r.n_system_mapped) for r in study.match_report(*study.sides(spans, 0), found.filter("ref_annotator = 0")).collect()] == [(2, 1, 2, 1)]
    assert study.matches_of(spans.limit(0), [0, 1]).count() == 0
    ratings = frame(spark, "coder string, item int, label string", ("a", 1, "x|y"), ("b", 1, "y|x"), ("a", 2, "x"), ("b", 2, "x|z"), ("a", 3, None), ("b", 3, "x"), ("a", 4, "q"), ("b", 4, "r"), ("b", 4, "r"))
    assert rows(study.mean_distance(ratings)) == [("a", "b", 3, 0.5)]
    with pytest.raises(ValueError):
        study.matches_of(spans, [0], matcher="other")


def test_copies(spark):
    docs = frame(spark, "title string, doc_uid long, annotator string, n long", ("a", 1, "m", 5), ("a", 2, "x", 5), ("a", 3, "y", 1), ("b", 4, "m", 1), ("b", 5, "x", 9), ("c", 6, "x", 0), (None, 7, None, 2), (None, 8, None, None))
    kept = lambda df: sorted(r.doc_uid for r in df.collect())
    assert kept(selection.without_spare_copies(docs, "n", F.col("doc_uid") == 4, "m")) == [2, 4, 6, 7]  # 5 is the only spare copy of b
    assert kept(selection.cleaned(docs, "n")) == [1, 5, 7] and kept(selection.cleaned(docs.filter("title is not null"), "n", "median_units")) == [1, 4]
    listed = frame(spark, "title string, annotator string", ("a", "y"), ("a", "y"), ("c", "nobody"))
    assert kept(selection.kept_by_list(docs, listed)) == [3, 6]
    scores = frame(spark, "doc_uid long, score double", (1, 0.2), (2, 0.9), (2, 0.3), (5, None))
    assert {r.title: r.doc_uid for r in selection.best_scored(docs, scores).collect()} == {"a": 2, "b": 4, "c": 6, None: 7}
    out = frame(spark, "annotator string, n long", ("m", 5), (None, None))
    assert kept(selection.without_records(docs, out)) == [2, 3, 4, 5, 6, 7]
    with pytest.raises(ValueError):
        selection.cleaned(docs, "n", "best")
    titles = frame(spark, "title string, symbol string", ("Acme01_x", "clash"), ("12_x", "clash"), ("zz99_q", "clash"), ("x", "clash"), (None, "clash"))
    companies = frame(spark, "symbol string, industry string", ("ACME", "cars"))
    assert sorted((str(r.title), r.symbol, r.industry) for r in selection.with_company(titles.drop("symbol"), companies).collect()) == [("12_x", "Unresolved", None), ("Acme01_x", "acme", "cars"), ("None", None, None), ("x", None, None), ("zz99_q", "zz", None)]
    assert selection.without_spare_copies(docs.limit(0), "n", F.lit(None).cast("boolean"), "m").count() == 0


def test_checks(spark):
    types = frame(spark, "a string, b string", ("CapitalReturns", None), ("X", "y"), (None, "z"))
    assert rows(checks.clean_types(types, "a", "b")) == [("Dividend", "Other"), ("X", "y")]
    events = frame(spark, "doc_uid long, element_id long", (1, 1), (1, 2), (1, 3), (2, 1))
    components = frame(spark, "doc_uid long, node long, component long", (1, 1, 1), (1, 2, 1))
    roles = frame(spark, "doc_uid long, element_id long, role string", (1, 2, "r"), (1, 3, None), (2, 1, "q"))
    assert rows(checks.with_role_around(events, roles, components, F.col("role") == "r")) == [(1, 1, True), (1, 2, True), (1, 3, False), (2, 1, False)]
    sents = frame(spark, "doc_id long, sent_idx int", *[(1, i) for i in range(6)], (2, 0), (3, None))
    assert rows(checks.sparse_documents(sents, frame(spark, "doc_id long", (1,), (2,)))) == [(1, 6, 1, True, False), (3, 0, 0, True, False)]
    assert rows(checks.counters(frame(spark, "g string, k string", ("a", "x"), ("b", "x"), (None, "x"), ("a", None)), "g", "k")) == [("a", "x", 1), ("a", None, 1), ("all", "x", 2), ("all", None, 1), ("b", "x", 1)]
    assert rows(checks.not_empty(frame(spark, "i int, l array<int>", (1, []), (2, None), (3, [0])), "l")) == [(3, [0])]
    df = frame(spark, "k string, t string", ("b", "1.5% of it"), ("y", None), ("none", ""))
    assert [r[0] for r in df.select(checks.looked_up(F.col("k"), {"x": ["b"], "y": []})).collect()] == ["x", "y", None]
    assert [r[0] for r in df.select(checks.substituted(F.col("t"), [("[0-9.]+", "#"), ("%", " pct")])).collect()] == ["# pct of it", None, ""]
    assert len({r[0] for r in frame(spark, "a string, b string", ("x", None), (None, "x"), ("x", "")).select(checks.identity("a", "b")).collect()}) == 2
    assert rows(checks.unfinished(frame(spark, "doc_uid int, element_id int, r string", (1, 1, None), (1, 2, "x"), (1, 3, "x")), frame(spark, "doc_uid int, element_id int", (1, 1), (1, 2), (1, 2)), "r")) == [(1, 1, True, False), (1, 3, False, True)]
