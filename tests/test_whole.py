"""Registered queries use all of their input: held against plain Python over the views, not against the SQL, which may make the same cut."""

import os
from collections import defaultdict

import pytest

from annoloom.operators import lexical, quality
from annoloom.functions import fuzzy
from annoloom.plans import source_queries, span_queries, table_queries
from annoloom.plans.adapters import spans, tokens
from annoloom.sources.tables import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def units(spark):
    """(doc_id, sentence or None, annotator, span_id, first, last, label) of every span, and the sentences of each document."""
    sent = {(r.doc_id, r.tok_idx): r.sent_idx for r in tokens(spark, DATA).collect()}
    rows = []
    for r in spans(spark, DATA).collect():
        a, b = sent.get((r.doc_id, r["first"])), sent.get((r.doc_id, r["last"]))
        rows.append((r.doc_id, a if a == b else None, r.annotator, r.span_id, r["first"], r["last"], r.label))
    last = defaultdict(int)
    for (d, _), s in sent.items():
        last[d] = max(last[d], s)
    return rows, last


def by_sentence(rows, annotator):
    out = defaultdict(list)
    for r in rows:
        if r[2] == annotator and r[1] is not None:
            out[r[:2]].append(r[3:])
    return out


def test_opinion_triples_of_all_targets(spark, units):
    gold, targets = by_sentence(units[0], 0), by_sentence(units[0], 1)
    want = defaultdict(set)
    for key, ts in targets.items():
        for t in ts:
            for u in gold.get(key, []):
                want[(*key, t[0], u[3])].add(u[0])
    got = span_queries.opinion_triples(spark, DATA).collect()
    assert {(r.doc_id, r.sent_idx, r.target_id, r.sentiment): r.n_opinions for r in got} == {k: len(v) for k, v in want.items()}
    order = sorted(want, key=lambda k: (k[0], k[1], min(want[k]), k[2], k[3]))
    assert [(r.doc_id, r.sent_idx, r.target_id, r.sentiment) for r in sorted(got, key=lambda r: (r.doc_id, r.sent_idx, r.triple_no))] == order


def test_hulls_of_all_targets(spark, units):
    targets = by_sentence(units[0], 1)
    want = []
    for key, us in by_sentence(units[0], 0).items():
        ts = targets.get(key, [])
        want += [(*key, first, last, min([first, *(t[1] for t in ts)]), max([last, *(t[2] for t in ts)])) for _, first, last, _ in us]
    got = [(r.doc_id, r.sent_idx, r["first"], r["last"], r.hull_first, r.hull_last) for r in span_queries.polar_instances_hull(spark, DATA).collect()]
    assert sorted(got) == sorted(want)


def test_extension_takes_in_all_parts(spark, units):
    targets = by_sentence(units[0], 1)
    want = []
    for key, us in by_sentence(units[0], 0).items():
        parts = sorted({t[1:3] for t in targets.get(key, [])})
        for span_id, first, last, _ in us if parts else []:
            for a, b in parts:
                if max(0, a - last, first - b) + b - a + 1 < 24:
                    first, last = min(first, a), max(last, b)
            want.append((key[0], span_id, first, last))
    got = [(r.doc_id, r.span_id, r["first"], r["last"]) for r in span_queries.capped_extension(spark, DATA).collect()]
    assert sorted(got) == sorted(want)


def test_pairs_of_all_targets(spark, units):
    n = defaultdict(lambda: [0, 0])
    gold, targets = by_sentence(units[0], 0), by_sentence(units[0], 1)
    for r in units[0]:
        if r[2] < 2:
            n[r[0]][r[2]] += 1
    kept = defaultdict(int)
    for key, us in gold.items():
        kept[key[0]] += len(us) * len(targets.get(key, []))
    want = {d: (kept[d], a * b - kept[d]) for d, (a, b) in n.items() if a and b}
    assert {r.doc_id: (r.n_kept, r.n_removed) for r in span_queries.cross_sentence_removed(spark, DATA).collect()} == want


def test_density_counts_all_units(spark, units):
    n = defaultdict(int)
    for r in units[0]:
        n[r[0]] += r[2] == 0
    want = {d: (last + 1, n[d]) for d, last in units[1].items() if n[d] / (last + 1) <= 0.75}
    assert {r.doc_id: (r.n_sentences, r.n_units) for r in span_queries.low_density_docs(spark, DATA).collect()} == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_similarity_of_whole_names(spark):
    parts = {r.p_partkey: (r.p_name, r.p_type) for r in table(spark, DATA, "part").collect()}
    assert any(" " in a for a, _ in parts.values())
    got = {r.p_partkey: r.score for r in source_queries.fuzzy_similarity(spark, DATA).collect()}
    assert got == {k: fuzzy.weighted(a or "", b or "") for k, (a, b) in parts.items()}


def pooled(spark):
    langs = {r.doc_id: (r.lang or "und").lower() for r in table(spark, DATA, "documents").select("doc_id", "lang").collect()}
    words = defaultdict(list)
    for r in sorted(tokens(spark, DATA).collect(), key=lambda r: (r.doc_id, r.tok_idx)):
        words[langs[r.doc_id]].append(r.tok.lower())
    return {k: [len(set(w[i : i + 25])) / 25 for i in range(len(w) - 24)] for k, w in words.items()}


def test_segments_of_a_whole_language(spark):
    want = {k: sum(runs[::25]) / len(runs[::25]) for k, runs in pooled(spark).items() if runs}
    got = {r.lang: r.msttr for r in table_queries.msttr_by_lang(spark, DATA).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_windows_of_a_whole_language(spark):
    want = {k: sum(runs) / len(runs) for k, runs in pooled(spark).items() if runs}
    got = {r.lang: r.mattr for r in table_queries.mattr_by_lang(spark, DATA).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    by_blocks = lexical.mattr(table_queries._by_lang(spark, DATA), ["lang"], ["doc_id", "tok_idx"], block=32)
    assert all(abs(r.mattr - want[r.lang]) < 1e-9 for r in by_blocks.collect())


def test_cascade_by_text_and_wider_tiers(spark, units):
    tok = {(r.doc_id, r.tok_idx): r.tok for r in tokens(spark, DATA).collect()}
    docs = defaultdict(lambda: defaultdict(list))
    for d, sent, annotator, span_id, first, last, label in units[0]:
        docs[d][annotator].append((span_id, first, last, label, sent, [tok[d, i] for i in range(first, last + 1)]))

    def dice(a, b):
        return 1.0 if sorted(a) == sorted(b) else 2.0 * len(set(a) & set(b)) / (len(a) + len(b))

    want = {}
    for d, by in docs.items():
        for g in by[0]:
            for annotator in (1, 2):
                ranked = []
                for s in by[annotator]:
                    far = max(g[1] - s[2], s[1] - g[2])
                    common = min(g[2], s[2]) - max(g[1], s[1]) + 1
                    if common > 0:
                        ranked.append((0, -2.0 * common / (len(g[5]) + len(s[5])), 0, s[0], "span"))
                    elif g[3] == s[3]:
                        how = "sentence" if g[4] is not None and g[4] == s[4] else "window" if far <= 25 else "document"
                        ranked.append((("sentence", "window", "document").index(how) + 1, -dice(g[5], s[5]), far, s[0], how))
                if ranked:
                    want[d, annotator, g[0]] = min(ranked)[3:]
    got = span_queries.strategy_cascade_match(spark, DATA).collect()
    assert {(r.doc_id, r.annotator, r.gold_id): (r.sys_id, r.how) for r in got} == want and len(got) == len(want)
    assert {how for _, how in want.values()} > {"span"}


def test_keywords_one_slip_away_and_with_accents(spark):
    rows = [(1, 0, "internationalisations,"), (1, 1, "internationalizations"), (1, 2, "Bénéfice."), (1, 3, "bnfice"), (1, 4, "profitable")]
    toks = spark.createDataFrame(rows, "doc_id long, tok_idx int, tok string")
    covered = spark.createDataFrame([], "doc_id long, label string, tok_idx int")
    got = quality.keywords_missed(toks, covered, {"a": ["internationalizations"], "b": ["bénéfice", "profit"]}).collect()
    assert {(r.doc_id, r.label, r.n_missed) for r in got} == {(1, "a", 2), (1, "b", 1)}


def test_all_event_types_are_zipped(spark):
    want = defaultdict(lambda: defaultdict(int))
    for r in table(spark, DATA, "events").select("user_id", "event_type").collect():
        want[r.user_id][r.event_type] += 1
    got = [r.asDict() for r in table_queries.dict_zip_full_outer(spark, DATA).collect()]
    kinds = {k for n in want.values() for k in n}
    assert all(set(r) == kinds | {"user_id"} for r in got) and len(got) == len(want)
    assert all(r[k] == want[r["user_id"]][k] for r in got for k in kinds)
