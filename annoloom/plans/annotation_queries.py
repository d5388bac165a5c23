"""Extents, targets, studies, copies and checks over the annotation tables.

The tables have positions but no tokens. Their grid view makes them: a token is 8 positions, a sentence 25 tokens, a word and
its tag follow from its place. Every element of the tables is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import agreement, checks, export, extents, graph, matching, pipelines, quality, scoring, selection, study
from ..operators import spans as sp
from ..session import large, stored
from ..sources.tables import table
from .adapters import RATINGS, SPANS, TOKENS, ratings, spans, tokens
from .span_queries import _CAND, _sides, _six
from .table_queries import _X, _elements, _links, _relations

TAGS = ("NN", "PRP", "WP", "VB", "PRP$")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = F.expr("cast(begin_pos div 8 as int)"), F.expr("cast((end_pos - 1) div 8 as int)")
    placed = _elements(spark, sf_dir).filter("begin_pos < end_pos").select("doc_uid", "element_id", "layer", "text", first.alias("first"), last.alias("last"))
    return placed.withColumn("sent_idx", F.expr("case when first div 25 = last div 25 then cast(first div 25 as int) end"))


def _grid(units: DataFrame) -> DataFrame:
    per = units.groupBy("doc_uid").agg(F.max("last").alias("m")).select("doc_uid", F.explode(F.sequence(F.lit(0), "m")).alias("tok_idx"))
    tag = F.element_at(F.array(*(F.lit(t) for t in TAGS)), F.expr("cast((doc_uid + tok_idx * 3) % 5 as int)") + 1)
    return per.select("doc_uid", "tok_idx", F.expr("cast(tok_idx div 25 as int)").alias("sent_idx"), F.concat(F.lit("w"), F.expr("(doc_uid * 31 + tok_idx * 7) % 1000").cast("string")).alias("tok"), tag.alias("tag"))


def _parts(spark: SparkSession, sf_dir: str, units: DataFrame) -> DataFrame:
    """Participants, fillers and discontiguous triggers of events, a row for each link."""
    ties = _links(spark, sf_dir).select("doc_uid", F.col("event_id").alias("element_id"), "target_id", "link_role")
    own = units.select("doc_uid", F.col("element_id").alias("target_id"), "layer", "first", "last", "sent_idx")
    return ties.join(own, ["doc_uid", "target_id"])


def _extent(spark: SparkSession, sf_dir: str, layer: str, layers: list[str], same_sentence: bool = True) -> DataFrame:
    units = stored(_units(spark, sf_dir))
    found = extents.extent_tokens(units.filter(F.col("layer") == layer), _parts(spark, sf_dir, units), _grid(units), layers, same_sentence)
    keys = extents.token_keys(F.col("doc_uid").cast("string"), F.col("tok_ids"))
    return extents.extent_text(found).select("doc_uid", "element_id", "n_tokens", F.array_join(keys, " ").alias("token_ids"), "text")


def event_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extent(spark, sf_dir, "event", ["discontiguous"])


def event_extents_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extent(spark, sf_dir, "event", ["discontiguous", "participant", "filler"])


def extents_across_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extent(spark, sf_dir, "event", ["participant", "filler"], same_sentence=False)


def participant_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extent(spark, sf_dir, "participant", [])


def unit_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir).select("doc_uid", F.col("target_id").alias("element_id"), "event_id")
    return extents.containers(links).select("doc_uid", "element_id", F.array_join(F.transform("owners", lambda x: x.cast("string")), " ").alias("owners"), "n_owners")


def token_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = extents.place_in_sentence(tokens(spark, sf_dir))
    return placed.groupBy("doc_id", "sent_idx").agg(F.max("sent_tok_idx").alias("last_place"), F.min_by("tok", "sent_tok_idx").alias("first_tok"), F.max_by("tok", "sent_tok_idx").alias("last_tok"))


KINDS = {"event": ["event"], "argument": ["participant", "filler"], "trigger": ["event", "discontiguous"]}


def token_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = stored(_units(spark, sf_dir))
    rated = extents.token_ratings(_grid(units), units.withColumn("label", F.col("layer")), KINDS)
    return rated.groupBy(*KINDS, "labels").agg(F.count("*").alias("n"), F.sum("tok_idx").alias("places"))


def joined_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of extent as one column: a token is in a trigger if an event or a discontiguous part covers it."""
    units = stored(_units(spark, sf_dir))
    marks = sp.span_tokens(units.select("doc_uid", "layer", "first", "last")).groupBy("doc_uid", "tok_idx").pivot("layer", ["event", "discontiguous"]).agg(F.first("layer"))
    merged = marks.withColumn("extent", extents.either(["event", "discontiguous"], "trigger_event"))
    return merged.groupBy("doc_uid").agg(F.count("extent").alias("n_trigger_tokens"), F.count_if(F.col("extent").isNull()).alias("n_other_tokens"))


def _targets(spark: SparkSession, sf_dir: str, units: DataFrame) -> DataFrame:
    parts = _parts(spark, sf_dir, units).filter(F.col("layer").isin("participant", "filler"))
    return parts.select("doc_uid", F.col("element_id").alias("unit_id"), "target_id", "first", "last", "sent_idx").distinct()


def _prepared(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, ...]:
    units = stored(_units(spark, sf_dir))
    events = units.filter("layer = 'event'").select("doc_uid", F.col("element_id").alias("unit_id"), "sent_idx")
    targets = stored(_targets(spark, sf_dir, units))
    referents = _relations(spark, sf_dir).filter("pronom_id <> 0 and referent_id <> 0").select("doc_uid", F.col("pronom_id").alias("element_id"), "referent_id")
    pronouns = pipelines.pronominal_spans(units, _grid(units), scalars.PRONOUN_TAGS)
    return events, targets, referents, units, pronouns


def prepared_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.prepare(*_prepared(spark, sf_dir))[1]


def prepared_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.prepare(*_prepared(spark, sf_dir))[0]


def prepared_with_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.prepare(*_prepared(spark, sf_dir), extend=64, keep_bare_units=True)[1]


def replaced_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, targets, referents, units, _ = _prepared(spark, sf_dir)
    return pipelines.replaced_targets(targets, referents, units)


def preparation_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, targets, referents, units, pronouns = _prepared(spark, sf_dir)
    inside = stored(pipelines.targets_in_sentence(events, targets))
    plain = stored(pipelines.without_pronominal(inside, pronouns))
    with_targets = events.join(targets, ["doc_uid", "unit_id"], "left_semi")
    return pipelines.loss(targets, inside, "sentence").unionByName(pipelines.loss(inside, plain, "pronoun")).unionByName(pipelines.loss(with_targets, with_targets.join(plain, ["doc_uid", "unit_id"], "left_semi"), "unit"))


def units_without_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, targets, *_ = _prepared(spark, sf_dir)
    return pipelines.without_units(events, pipelines.targets_in_sentence(events, targets)).select("doc_uid", "unit_id")


def valid_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments with a target's role of their event's type; events take the typology's types in turn, as the tables hold none."""
    types = table(spark, sf_dir, "typology")
    names = types.select(F.col("full_name").alias("type"), (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("full_name")) - 1).alias("turn"))  # a fixed list
    typed = _links(spark, sf_dir).select("doc_uid", "link_id", "event_id", F.trim("link_role").alias("role"), (F.col("event_id") % 61).cast("int").alias("turn")).join(names, "turn")
    return pipelines.target_roles(typed, types).select("doc_uid", "link_id", "type", "role")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its title's id, its annotator and its events."""
    title = F.nullif(F.regexp_extract(F.lower("document_title"), r"([a-z]+[0-9]+)_", 1), F.lit(""))
    annotator = F.nullif(F.regexp_extract("annotator_id", r"0*([0-9]+)", 1), F.lit(""))
    rows = table(spark, sf_dir, "elements").filter("doc_uid is not null")
    return rows.groupBy("doc_uid").agg(F.min(title).alias("title"), F.min(annotator).alias("annotator"), F.count_distinct(F.when(F.col("layer") == "event", F.col("element_id"))).alias("n_events"))


def study_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.titles_by_annotator(_documents(spark, sf_dir))


def study_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.ordered_pairs(_documents(spark, sf_dir))


def study_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.by_annotator(spans(spark, sf_dir), F.col("label") == "positive")


def study_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spans(spark, sf_dir))
    return study.match_counts(s, study.matches_of(s, [0, 1, 2]))


def study_document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spans(spark, sf_dir))
    scores = study.document_scores(s, 1, 2, ["label"])
    return _six(scores.select("doc_id", "n_gold", "n_system", "p", "r", "f1", "p_relaxed", "r_relaxed", "f1_relaxed"))


def study_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, system = _sides(spark, sf_dir)
    return _six(study.mean_confusion(scoring.confusion(gold, system, matching.match(gold, system))))


def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, system = _sides(spark, sf_dir)
    return study.match_report(gold, system, matching.match(gold, system))


def label_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(study.mean_distance(ratings(spark, sf_dir).withColumn("label", F.translate("label", ". ", "||"))))


def top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent labels of each coder."""
    n = ratings(spark, sf_dir).filter("label is not null").groupBy("coder", "label").agg(F.count("*").alias("n"))
    return study.ranked(n, ["coder"], [F.desc("n"), F.asc("label")], 3)


TEST_DAY = "substr(title, -1) = '1'"


def copies_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.without_spare_copies(_documents(spark, sf_dir), "n_events", F.expr(TEST_DAY) & (F.col("annotator") == "7"), "7").select("doc_uid", "title", "annotator", "n_events")


def copies_with_most_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.cleaned(_documents(spark, sf_dir), "n_events").select("doc_uid", "title", "n_events")


def copies_with_median_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.cleaned(_documents(spark, sf_dir).filter("title is not null"), "n_events", "median_units").select("doc_uid", "title", "n_events")


def copies_best_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document's three annotations the one that the others agree with best."""
    s = stored(spans(spark, sf_dir))
    found = [scoring.prf(scoring.nugget_sums(*study.sides(s, a), matching.match(*study.sides(s, a)), ["label"]), ["label"]).select(F.concat_ws("-", "doc_id", F.lit(a)).alias("doc_uid"), F.round("f1", 6).alias("score")) for a in (0, 1, 2)]
    docs = s.select(F.col("doc_id").alias("title"), F.concat_ws("-", "doc_id", "annotator").alias("doc_uid")).distinct()
    return selection.best_scored(docs, found[0].unionByName(found[1]).unionByName(found[2]))


def copies_by_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _documents(spark, sf_dir).filter("annotator is not null").groupBy("title").agg(F.max("annotator").alias("annotator"))
    return selection.kept_by_list(_documents(spark, sf_dir), listed).select("doc_uid", "title", "annotator")


def records_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    excluded = spark.createDataFrame([("7", 0), (None, 1)], "annotator string, n_events long")
    return selection.without_records(_documents(spark, sf_dir), excluded).select("doc_uid", "title", "annotator", "n_events")


def companies_of_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = table(spark, sf_dir, "documents").filter("ticker is not null").groupBy(F.lower(F.trim("ticker")).alias("symbol")).agg(F.count("*").alias("n_news"))
    return selection.with_company(_documents(spark, sf_dir), companies).select("doc_uid", "title", "symbol", "n_news")


def roles_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    components = graph.star_components(links, "event_id", "target_id", ["doc_uid"]).withColumnRenamed("group", "component")
    events = _elements(spark, sf_dir).filter("layer = 'event'").select("doc_uid", "element_id")
    roles = links.select("doc_uid", F.col("event_id").alias("element_id"), F.lower(F.trim("link_role")).alias("role"))
    found = checks.with_role_around(events, roles, components, F.col("role") == "rival")
    return found.groupBy("doc_uid").agg(F.count("*").alias("n_events"), F.count_if("has_role").alias("n_with_role"))


def types_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.clean_types(table(spark, sf_dir, "typology"), "maintype_name", "subtype_name").select("full_name", "maintype_name", "subtype_name")


def units_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    fillers = table(spark, sf_dir, "fillers").filter("element_id is not null").groupBy("doc_uid", "element_id").agg(F.max("filler_role").alias("role"))
    linked = _links(spark, sf_dir).select("doc_uid", F.col("target_id").alias("element_id"))
    return checks.unfinished(fillers, linked, "role")


def documents_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.sparse_documents(tokens(spark, sf_dir), spans(spark, sf_dir).filter("annotator = 0 and label = 'negative'"))


def sentences_picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = tokens(spark, sf_dir)
    return checks.picked_sentences(sp.sentence_of_spans(spans(spark, sf_dir).filter("annotator = 0"), toks), toks, "label")


def _triples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    toks = tokens(spark, sf_dir)
    placed = large(stored(sp.sentence_of_spans(spans(spark, sf_dir), toks)))
    return toks, placed, export.triples(placed.filter("annotator = 0"), placed.filter("annotator = 1"))


def sentences_with_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks, _, triples = _triples(spark, sf_dir)
    per = triples.groupBy("doc_id", "sent_idx").agg(F.collect_list("triple_no").alias("triples"))
    all_ = toks.select("doc_id", "sent_idx").distinct().join(per, ["doc_id", "sent_idx"], "left")
    return checks.not_empty(all_, "triples").select("doc_id", "sent_idx", F.size("triples").alias("n_triples"))


def triple_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks, placed, triples = _triples(spark, sf_dir)
    tags = sp.bio_tags(toks, placed.filter("annotator = 0").withColumn("ord", F.col("span_id")), ["doc_id"], "ord")
    return checks.triple_stats(toks, triples, tags)


def role_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.counters(_links(spark, sf_dir).withColumn("role", F.coalesce(F.lower(F.trim("link_role")), F.lit("none"))), "link_layer", "role")


def weak_events_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _elements(spark, sf_dir).filter("layer = 'event'").select("doc_uid", "element_id")
    weak = events.join(_links(spark, sf_dir).select("doc_uid", F.col("event_id").alias("element_id")), ["doc_uid", "element_id"], "left_anti")
    return checks.listed_by(weak, ["doc_uid"], "element_id").select("doc_uid", "n", F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("events"))


def distinct_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each role's distinct arguments and events."""
    links = _links(spark, sf_dir).withColumn("role", F.lower(F.trim("link_role")))
    return links.groupBy("link_layer", "role").agg(F.count_distinct("doc_uid", "target_id").alias("n_arguments"), F.count_distinct("doc_uid", "event_id").alias("n_events"))


def unit_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir).select("doc_uid", "layer", "element_id", checks.identity("doc_uid", "layer", "element_id", "text", "begin_pos", "end_pos").alias("identity"))


def texts_substituted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(r"[0-9]+([.,][0-9]+)*", "#"), (r"%", " percent"), (r"\s+", " "), (r"^the ", "")]
    return _elements(spark, sf_dir).select(checks.substituted(F.lower("text"), rules).alias("text")).groupBy("text").agg(F.count("*").alias("n"))


def months_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "elements").groupBy(F.date_format("ingested_at", "yyyyMMdd").alias("day")).agg(F.count("*").alias("n"))


def roles_looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"time": ["when"], "place": ["where"], "money": ["funds", "oldsum", "sum"]}
    role = checks.looked_up(F.lower(F.trim("link_role")), names)
    return _links(spark, sf_dir).groupBy(role.alias("kind")).agg(F.count("*").alias("n"))


def tokens_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens between blanks beside tokens between blanks and hyphens."""
    other = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "[ \n-]+"), lambda x: x != "")).alias("tok_idx", "tok"))
    both = checks.side_by_side(tokens(spark, sf_dir), other, ["doc_id"], "tok_idx", "tok")
    return both.groupBy("doc_id").agg(F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("n_same"), F.count_if(F.col("a").isNull()).alias("n_only_b"), F.count("*").alias("n"))


def texts_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of participants said more than once, with their places."""
    people = _elements(spark, sf_dir).filter("layer = 'participant'").withColumn("place", F.concat_ws("-", "doc_uid", "element_id"))
    return quality.repeated_values(people, "text", "place")


def texts_shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir).groupBy(scalars.short_text(F.col("text"), 15).alias("short")).agg(F.count("*").alias("n"))


def span_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens between the two systems' spans of one anchor, 0 where they overlap."""
    s = stored(spans(spark, sf_dir))
    a, b = (s.filter(F.col("annotator") == k).select("doc_id", "span_id", F.col("first").alias(f"f{k}"), F.col("last").alias(f"l{k}")) for k in (1, 2))
    gap = sp.span_distance(F.col("f1"), F.col("l1"), F.col("f2"), F.col("l2"))
    return a.join(b, ["doc_id", "span_id"]).groupBy(gap.alias("gap")).agg(F.count("*").alias("n"))


def pronominal_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = stored(_units(spark, sf_dir))
    return pipelines.pronominal_spans(units, _grid(units), scalars.PRONOUN_TAGS)


def pairwise_prf_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of labels and, with a null label, the micro mean, averaged over all pairs of coders."""
    scores = agreement.pairwise_prf(ratings(spark, sf_dir))
    return _six(scores.groupBy("label").agg(F.count("*").alias("n_pairs"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1"))))


def ie_full_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold spans as events, the first system's spans of the same anchor as their arguments, both systems' as relations."""
    toks, placed, _ = _triples(spark, sf_dir)
    own = placed.filter("sent_idx is not null")
    args = own.filter("annotator = 1").select("doc_id", "span_id", "sent_idx", "first", "last", F.concat("label", F.lit("_x")).alias("role"))
    a, b = (own.filter(F.col("annotator") == k) for k in (1, 2))
    told = a.join(b.select("doc_id", "sent_idx", "span_id", F.col("first").alias("to_first"), F.col("last").alias("to_last")), ["doc_id", "sent_idx", "span_id"])
    relations = told.select("doc_id", "sent_idx", "first", "last", "to_first", "to_last", F.concat(F.lit("Pol."), "label").alias("label"))
    found = toks.select("doc_id", "sent_idx").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("doc_key"), F.format_string("[[0,0,\"N%d\"]]", "n").alias("ner"))
    return export.ie_json(toks, own.filter("annotator = 0"), args, relations, found)


def tagged_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks, placed, _ = _triples(spark, sf_dir)
    return export.tagged_triples(toks, placed.filter("annotator = 0"), placed.filter("annotator = 1")).drop("doc_id", "sent_idx")


def polar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks, placed, _ = _triples(spark, sf_dir)
    splits = toks.select("doc_id").distinct().withColumn("split", F.when(F.col("doc_id") % 3 == 0, "dev").otherwise("train"))
    return export.polar_rows(toks, placed.filter("annotator = 0"), placed.filter("annotator = 1"), splits)


QUERIES = {
    f.__name__: f
    for f in (
        event_extents, event_extents_full, extents_across_sentences, participant_texts, unit_containers, token_places, token_ratings, joined_extents,
        prepared_targets, prepared_units, prepared_with_extension, replaced_anywhere, preparation_loss, units_without_targets, valid_targets,
        study_titles, study_pairs, study_units, study_match_counts, study_document_scores, study_confusion, match_report, label_distances, top_labels,
        copies_left, copies_with_most_events, copies_with_median_events, copies_best_scored, copies_by_list, records_excluded, companies_of_titles,
        roles_around, types_clean, units_unfinished, documents_sparse, sentences_picked, sentences_with_triples, triple_stats, role_counters, weak_events_listed, distinct_arguments,
        unit_identities, texts_repeated, texts_shortened, span_gaps, pronominal_units, pairwise_prf_mean, ie_full_documents, tagged_triples, polar_rows, texts_substituted, months_named, roles_looked_up, tokens_side_by_side,
    )
}

# The grid view in SQL: units, tokens, parts of events, targets.
_U = f"""{_X}, u as (select doc_uid, element_id, layer, text, (begin_pos // 8)::integer as first, ((end_pos - 1) // 8)::integer as last, case when begin_pos // 200 = (end_pos - 1) // 200 then begin_pos // 200 end::integer as sent_idx from el where begin_pos < end_pos),
tk as (select doc_uid, tok_idx, tok_idx // 25 as sent_idx, 'w' || ((doc_uid * 31 + tok_idx * 7) % 1000) as tok, ['NN', 'PRP', 'WP', 'VB', 'PRP$'][((doc_uid + tok_idx * 3) % 5)::integer + 1] as tag
  from (select doc_uid, unnest(range(max(last) + 1))::integer as tok_idx from u group by doc_uid)),
pt as (select l.doc_uid, l.event_id as element_id, l.target_id, u.layer, u.first, u.last, u.sent_idx from lk l join u on u.doc_uid = l.doc_uid and u.element_id = l.target_id)"""


def _extent_sql(layer: str, layers: list[str], same_sentence: bool = True) -> str:
    named = ", ".join(f"'{x}'" for x in layers) or "''"
    home = "and t.sent_idx = c.first // 25" if same_sentence else ""
    return f"""{_U}, x as (
  select c.doc_uid, c.element_id, t.tok_idx, t.tok from u c join tk t on t.doc_uid = c.doc_uid and t.tok_idx between c.first and c.last where c.layer = '{layer}'
  union select c.doc_uid, c.element_id, t.tok_idx, t.tok from u c join pt p on p.doc_uid = c.doc_uid and p.element_id = c.element_id and p.layer in ({named}) join tk t on t.doc_uid = p.doc_uid and t.tok_idx between p.first and p.last {home} where c.layer = '{layer}')
select doc_uid, element_id, count(*)::integer as n_tokens, string_agg(doc_uid || '_' || tok_idx, ' ' order by tok_idx) as token_ids, string_agg(tok, ' ' order by tok_idx) as text from x group by 1, 2"""


_T = f"""{_U}, ev as (select doc_uid, element_id as unit_id, sent_idx from u where layer = 'event'),
tg as (select distinct doc_uid, element_id as unit_id, target_id, first, last, sent_idx from pt where layer in ('participant', 'filler')),
rf as (select distinct r.doc_uid, r.pronom_id as target_id, u.element_id as new_id, u.first as nf, u.last as nl, u.sent_idx as ns from rel r join u on u.doc_uid = r.doc_uid and u.element_id = r.referent_id),
pron as (select u.doc_uid, u.element_id from u join tk on tk.doc_uid = u.doc_uid and tk.tok_idx between u.first and u.last group by 1, 2 having bool_and(tag in ('PRP', 'PRP$', 'WDT', 'WP', 'WP$')))"""
_SAME = f"""{_T}, moved as (select distinct t.doc_uid, t.unit_id, coalesce(r.new_id, t.target_id) as target_id, case when r.new_id is null then t.first else r.nf end as first, case when r.new_id is null then t.last else r.nl end as last, case when r.new_id is null then t.sent_idx else r.ns end as sent_idx
  from tg t left join rf r on r.doc_uid = t.doc_uid and r.target_id = t.target_id where r.new_id is null or r.ns is not distinct from t.sent_idx),
kept as (select m.* from moved m join ev using (doc_uid, unit_id, sent_idx) where not exists (select 1 from pron p where p.doc_uid = m.doc_uid and p.element_id = m.target_id))"""
_LOSS = f"""{_T}, inside as (select t.* from tg t join ev using (doc_uid, unit_id, sent_idx)), plain as (select i.* from inside i where not exists (select 1 from pron p where p.doc_uid = i.doc_uid and p.element_id = i.target_id)),
has as (select * from ev where (doc_uid, unit_id) in (select (doc_uid, unit_id) from tg)), n as (
  select 'sentence' as step, (select count(*) from tg) as n_before, (select count(*) from inside) as n_after union all select 'pronoun', (select count(*) from inside), (select count(*) from plain)
  union all select 'unit', (select count(*) from has), (select count(*) from has where (doc_uid, unit_id) in (select (doc_uid, unit_id) from plain)))
select step, n_before, n_after, n_before - n_after as n_removed, round(100.0::double * (n_before - n_after) / n_before, 1) as pct from n"""
_D = """with d as (select doc_uid, min(nullif(regexp_extract(lower(document_title), '([a-z]+[0-9]+)_', 1), '')) as title, min(nullif(regexp_extract(annotator_id, '0*([0-9]+)', 1), '')) as annotator, count(distinct case when layer = 'event' then element_id end) as n_events from elements where doc_uid is not null group by 1)"""
_ORDERED = f"""with {SPANS}, cand as (select g.doc_id, g.annotator as ref_annotator, s.annotator, g.span_id as gold_id, s.span_id as sys_id, 2.0::double * count(*) / (any_value(g.last - g.first + 1) + any_value(s.last - s.first + 1)) as dice
  from span_tokens g join span_tokens s on g.doc_id = s.doc_id and g.tok_idx = s.tok_idx and g.annotator <> s.annotator group by 1, 2, 3, 4, 5),
matches as (select * exclude (r) from (select *, rank() over (partition by doc_id, ref_annotator, annotator, gold_id order by dice desc) as r
  from (select * exclude (n) from (select *, row_number() over (partition by doc_id, ref_annotator, annotator, sys_id order by gold_id) as n from cand) where n = 1)) where r = 1),
have as (select distinct doc_id, annotator from spans),
gold as (select g.doc_id, g.annotator as ref_annotator, h.annotator, g.span_id as gold_id from spans g join have h on h.doc_id = g.doc_id and h.annotator <> g.annotator),
hit as (select doc_id, ref_annotator, annotator, gold_id, max(dice) as d from matches group by 1, 2, 3, 4),
sums as (select g.doc_id, g.ref_annotator, g.annotator, count(*) as n_gold, count(d) as n_matched, coalesce(sum(d), 0) as tp, count(*) - count(d) as fp from gold g left join hit using (doc_id, ref_annotator, annotator, gold_id) group by 1, 2, 3),
prf as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, tp / n_gold as r, coalesce(n_matched::double / nullif(n_matched + fp, 0), 0) as pr, n_matched::double / n_gold as rr from sums)"""
_F1 = "coalesce(2 * {0} * {1} / nullif({0} + {1}, 0), 0)"
_SENTS = f"with {TOKENS}, {SPANS}, sents as (select s.*, case when a.sent_idx = b.sent_idx then a.sent_idx end as sent_idx from spans s left join tokens a on a.doc_id = s.doc_id and a.tok_idx = s.first left join tokens b on b.doc_id = s.doc_id and b.tok_idx = s.last)"
_TRIPLES = f"{_SENTS}, tr as (select u.doc_id, u.sent_idx, t.span_id as target_id, u.label as sentiment from sents u join sents t on t.doc_id = u.doc_id and t.sent_idx = u.sent_idx where u.annotator = 0 and t.annotator = 1 group by 1, 2, 3, 4)"

ORACLES = {
    "event_extents": _extent_sql("event", ["discontiguous"]),
    "event_extents_full": _extent_sql("event", ["discontiguous", "participant", "filler"]),
    "extents_across_sentences": _extent_sql("event", ["participant", "filler"], same_sentence=False),
    "participant_texts": _extent_sql("participant", []),
    "unit_containers": f"{_X} select doc_uid, target_id as element_id, string_agg(event_id::varchar, ' ' order by event_id) as owners, count(*)::integer as n_owners from (select distinct doc_uid, target_id, event_id from lk where event_id is not null) group by 1, 2",
    "token_places": f"with {TOKENS} select doc_id, sent_idx, (count(*) - 1)::integer as last_place, arg_min(tok, tok_idx) as first_tok, arg_max(tok, tok_idx) as last_tok from tokens group by 1, 2",
    "token_ratings": f"""{_U}, m as (select tk.doc_uid, tk.tok_idx, case when bool_or(layer = 'event') then 1 else -1 end as event, case when bool_or(layer in ('participant', 'filler')) then 1 else -1 end as argument, case when bool_or(layer in ('event', 'discontiguous')) then 1 else -1 end as trigger,
      coalesce(string_agg(distinct layer, '|' order by layer), '-1') as labels from tk left join u on u.doc_uid = tk.doc_uid and tk.tok_idx between u.first and u.last group by 1, 2) select event, argument, trigger, labels, count(*) as n, sum(tok_idx)::bigint as places from m group by 1, 2, 3, 4""",
    "joined_extents": f"{_U}, m as (select u.doc_uid, unnest(range(first, last + 1)) as t, layer from u), k as (select doc_uid, t, bool_or(layer in ('event', 'discontiguous')) as hit from m group by 1, 2) select doc_uid, count(*) filter (hit) as n_trigger_tokens, count(*) filter (not hit) as n_other_tokens from k group by 1",
    "prepared_targets": f"{_SAME} select doc_uid, unit_id, target_id, first, last, sent_idx from kept",
    "prepared_units": f"{_SAME} select * from ev where (doc_uid, unit_id) in (select (doc_uid, unit_id) from kept)",
    "prepared_with_extension": f"""{_T}, more as (select t.doc_uid, t.unit_id, r.new_id as target_id, r.nf as first, r.nl as last, r.ns as sent_idx from tg t join rf r on r.doc_uid = t.doc_uid and r.target_id = t.target_id
      where r.nl - r.nf + 1 + greatest(0, r.nf - t.last, t.first - r.nl) < 64 and r.ns is not distinct from t.sent_idx), all_ as (select * from tg union select * from more)
      select a.doc_uid, a.unit_id, a.target_id, a.first, a.last, a.sent_idx from all_ a join ev using (doc_uid, unit_id, sent_idx) where not exists (select 1 from pron p where p.doc_uid = a.doc_uid and p.element_id = a.target_id)""",
    "replaced_anywhere": f"{_T} select distinct t.doc_uid, t.unit_id, coalesce(r.new_id, t.target_id) as target_id, case when r.new_id is null then t.first else r.nf end as first, case when r.new_id is null then t.last else r.nl end as last, case when r.new_id is null then t.sent_idx else r.ns end as sent_idx from tg t left join rf r on r.doc_uid = t.doc_uid and r.target_id = t.target_id",
    "preparation_loss": _LOSS,
    "units_without_targets": f"{_T} select doc_uid, unit_id from ev where not exists (select 1 from tg where tg.doc_uid = ev.doc_uid and tg.unit_id = ev.unit_id and tg.sent_idx = ev.sent_idx)",
    "valid_targets": f"""{_X}, ty as (select full_name, row_number() over (order by full_name) - 1 as turn from typology), ro as (select distinct full_name, unnest(list_concat(coalesce(participant, []), coalesce(filler, [])), recursive := true) from typology)
      select lk.doc_uid, lk.link_id, ty.full_name as type, trim(link_role) as role from lk join ty on ty.turn = lk.event_id % 61 where (ty.full_name, trim(link_role)) in (select (full_name, name) from ro where is_target)""",
    "study_titles": f"{_D}, h as (select distinct annotator, title from d where annotator is not null and title is not null) select annotator, count(*) as n_titles, (select count(distinct title) from h) - count(*) as n_missing from h group by 1",
    "study_pairs": f"{_D}, h as (select distinct annotator, title from d where annotator is not null and title is not null) select a.title, a.annotator as ref_annotator, b.annotator from h a join h b on a.title = b.title and a.annotator <> b.annotator",
    "study_units": f"with {SPANS} select annotator, count(*) as n_units, count(distinct doc_id) as n_docs from spans where label = 'positive' group by 1",
    "study_match_counts": f"{_ORDERED} select ref_annotator, annotator, sum(n_gold)::bigint as n_ref, sum(n_matched)::bigint as n_matched, round(100.0::double * sum(n_matched) / sum(n_gold), 1) as pct from sums group by 1, 2",
    "study_document_scores": f"""{_ORDERED} select doc_id, n_gold, (select count(*) from spans s where s.doc_id = prf.doc_id and s.annotator = 2) as n_system, round(p, 6) as p, round(r, 6) as r, round({_F1.format('p', 'r')}, 6) as f1, round(pr, 6) as p_relaxed, round(rr, 6) as r_relaxed, round({_F1.format('pr', 'rr')}, 6) as f1_relaxed
      from prf where ref_annotator = 1 and annotator = 2""",
    "study_confusion": f"""with {SPANS}, {_CAND}, firsts as (select doc_id, annotator, gold_id, min(sys_id) as sys_id from matches group by 1, 2, 3),
      base as (select x.annotator, g.label as gold_label, coalesce(s.label, 'None') as sys_label from (select distinct doc_id, annotator from spans where annotator > 0) x join spans g on g.doc_id = x.doc_id and g.annotator = 0
        left join firsts f on f.doc_id = x.doc_id and f.annotator = x.annotator and f.gold_id = g.span_id left join spans s on s.doc_id = x.doc_id and s.annotator = x.annotator and s.span_id = f.sys_id),
      sh as (select annotator, gold_label, sys_label, count(*)::double / sum(count(*)) over (partition by annotator, gold_label) as share from base group by 1, 2, 3)
      select gold_label, sys_label, round(sum(share) / (select count(distinct annotator) from base), 6) as mean_share from sh group by 1, 2""",
    "match_report": f"""with {SPANS}, {_CAND}, x as (select distinct doc_id, annotator from spans where annotator > 0) select annotator, n_gold, n_gold_mapped, n_system, n_system_mapped
      from (select x.annotator, count(*) as n_gold from x join spans g on g.doc_id = x.doc_id and g.annotator = 0 group by 1) full join (select annotator, count(*) as n_system from spans where annotator > 0 group by 1) using (annotator)
      left join (select annotator, count(distinct (doc_id, gold_id)) as n_gold_mapped, count(distinct (doc_id, sys_id)) as n_system_mapped from matches group by 1) using (annotator)""",
    "copies_left": f"""{_D}, s as (select *, coalesce(substr(title, -1) = '1' and annotator = '7', false) as test from d), c as (select *, count(*) over (partition by title) as n, count(*) filter (not test) over (partition by title) as spares,
      row_number() over (partition by title, test order by n_events desc, coalesce(annotator = '7', false), doc_uid) as place from s)
      select doc_uid, title, annotator, n_events from c where n = 1 or test or (spares > 1 and place = 1)""",
    "copies_with_most_events": f"{_D}, k as (select *, row_number() over (partition by title order by n_events desc, doc_uid) as n from d where n_events > 0) select doc_uid, title, n_events from k where n = 1",
    "copies_with_median_events": f"{_D}, m as (select *, avg(n_events) over (partition by title) as mean from d where n_events > 0 and title is not null), k as (select *, row_number() over (partition by title order by abs(n_events - mean), doc_uid) as n from m) select doc_uid, title, n_events from k where n = 1",
    "copies_best_scored": f"""{_ORDERED}, sc as (select doc_id, annotator, ref_annotator, round({_F1.format('p', 'r')}, 6) as score from prf), me as (select have.doc_id, have.annotator, s.score from have left join
      (select doc_id, ref_annotator, avg(score) as score from sc group by 1, 2) s on s.doc_id = have.doc_id and s.ref_annotator = have.annotator)
      select title, doc_uid from (select me.doc_id as title, me.doc_id || '-' || me.annotator as doc_uid, row_number() over (partition by me.doc_id order by coalesce(score, -1) desc, me.annotator) as n from me) where n = 1""",
    "copies_by_list": f"{_D}, l as (select title, max(annotator) as annotator from d group by 1), c as (select *, count(*) over (partition by title) as n from d) select doc_uid, c.title, c.annotator from c left join l on l.title = c.title and l.annotator = c.annotator where n = 1 or l.annotator is not null",
    "records_excluded": f"{_D} select doc_uid, title, annotator, n_events from d where not ((annotator is not distinct from '7' and n_events = 0) or (annotator is null and n_events = 1))",
    "companies_of_titles": f"""{_D}, c as (select lower(trim(ticker)) as symbol, count(*) as n_news from documents where ticker is not null group by 1), k as (select *, nullif(left(split_part(title, '_', 1), greatest(length(split_part(title, '_', 1)) - 2, 0)), '') as symbol from d)
      select doc_uid, title, k.symbol, n_news from k left join c on c.symbol = k.symbol""",
    "types_clean": "select full_name, case maintype_name when 'CapitalReturns' then 'Dividend' when 'FinancialResult' then 'FinancialReport' else maintype_name end as maintype_name, coalesce(subtype_name, 'Other') as subtype_name from typology where maintype_name is not null",
    "roles_around": f"""with recursive {_X[5:]}, s as (select doc_uid, event_id as a, target_id as b from lk where event_id <> target_id union select doc_uid, target_id, event_id from lk where event_id <> target_id),
      c(doc_uid, node, other) as (select doc_uid, a, a from s union select c.doc_uid, c.node, s.b from c join s on s.doc_uid = c.doc_uid and s.a = c.other), m as (select doc_uid, node, min(other) as component from c group by 1, 2),
      hit as (select distinct lk.doc_uid, coalesce(component, event_id) as component from lk left join m on m.doc_uid = lk.doc_uid and m.node = lk.event_id where lower(trim(link_role)) = 'rival'),
      e as (select el.doc_uid, coalesce(component, element_id) as component from el left join m on m.doc_uid = el.doc_uid and m.node = el.element_id where layer = 'event')
      select e.doc_uid, count(*) as n_events, count(hit.component) as n_with_role from e left join hit on hit.doc_uid = e.doc_uid and hit.component = e.component group by 1""",
    "units_unfinished": f"{_X}, f as (select doc_uid, element_id, max(filler_role) as role from fillers where element_id is not null group by 1, 2), t as (select f.doc_uid, f.element_id, role is null as no_label, not exists (select 1 from lk where lk.doc_uid = f.doc_uid and lk.target_id = f.element_id) as no_target from f) select * from t where no_label or no_target",
    "documents_sparse": f"""with {TOKENS}, {SPANS}, s as (select doc_id, count(distinct sent_idx) as n_sentences from tokens group by 1), u as (select doc_id, count(*) as n from spans where annotator = 0 and label = 'negative' group by 1),
      j as (select doc_id, n_sentences, coalesce(n, 0) as n_units, coalesce(n_sentences::double / nullif(n, 0) > 5, true) as sparse, n_sentences > 50 as long from s left join u using (doc_id)) select * from j where sparse or long""",
    "sentences_picked": f"{_SENTS}, p as (select doc_id, sent_idx, count(*) as n_units, count(distinct label) as n_labels from sents where annotator = 0 and sent_idx is not null group by 1, 2), k as (select doc_id, sent_idx, count(*) as n_tokens from tokens group by 1, 2) select * from p join k using (doc_id, sent_idx) where n_labels >= 3 and n_tokens <= 40",
    "sentences_with_triples": f"{_TRIPLES} select doc_id, sent_idx, count(*)::integer as n_triples from tr group by 1, 2",
    "triple_stats": f"""{_TRIPLES}, tg as (select doc_id, tok_idx, arg_max(tok_idx = first, span_id) as b from span_tokens where annotator = 0 group by 1, 2), n as (select (select count(distinct (doc_id, sent_idx)) from tokens) as n_sentences, count(distinct (doc_id, sent_idx)) as n_with_triples, count(*) as n_triples,
      count(*) filter (sentiment = 'positive') as n_positive, count(*) filter (sentiment = 'neutral') as n_neutral, count(*) filter (sentiment = 'negative') as n_negative, (select count(*) from tg where b) as n_b_tags from tr)
      select *, round(100.0::double * n_positive / n_triples, 1) as pct_positive, round(100.0::double * n_neutral / n_triples, 1) as pct_neutral, round(100.0::double * n_negative / n_triples, 1) as pct_negative from n""",
    "role_counters": f"{_X}, r as (select link_layer, coalesce(lower(trim(link_role)), 'none') as role from lk where link_layer is not null) select link_layer, role, count(*) as n from r group by 1, 2 union all select 'all', role, count(*) from r group by 2",
    "weak_events_listed": f"{_X} select doc_uid, count(*) as n, string_agg(element_id::varchar, ' ' order by element_id) as events from el where layer = 'event' and not exists (select 1 from lk where lk.doc_uid = el.doc_uid and lk.event_id = el.element_id) group by 1",
    "distinct_arguments": f"{_X} select link_layer, lower(trim(link_role)) as role, count(distinct case when target_id is not null and doc_uid is not null then (doc_uid, target_id) end) as n_arguments, count(distinct case when event_id is not null and doc_uid is not null then (doc_uid, event_id) end) as n_events from lk group by 1, 2",
    "unit_identities": f"{_X} select doc_uid, layer, element_id, md5(concat_ws(chr(31), coalesce(doc_uid::varchar, ''), coalesce(layer, ''), coalesce(element_id::varchar, ''), coalesce(text, ''), coalesce(begin_pos::varchar, ''), coalesce(end_pos::varchar, ''))) as identity from el",
    "texts_substituted": f"{_X} select regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]+([.,][0-9]+)*', '#', 'g'), '%', ' percent', 'g'), '\\s+', ' ', 'g'), '^the ', '', 'g') as text, count(*) as n from el group by 1",
    "months_named": "select strftime(ingested_at, '%Y%m%d') as day, count(*) as n from elements group by 1",
    "roles_looked_up": f"{_X} select case lower(trim(link_role)) when 'when' then 'time' when 'time' then 'time' when 'where' then 'place' when 'place' then 'place' when 'funds' then 'money' when 'oldsum' then 'money' when 'sum' then 'money' when 'money' then 'money' end as kind, count(*) as n from lk group by 1",
    "tokens_side_by_side": f"with {TOKENS}, o as (select doc_id, unnest(range(len(a)))::integer as tok_idx, unnest(a) as tok from (select doc_id, list_filter(regexp_split_to_array(text, '[ \n-]+'), lambda x: x <> '') as a from documents)) select doc_id, count(*) filter (t.tok is not distinct from o.tok) as n_same, count(*) filter (t.tok is null) as n_only_b, count(*) as n from tokens t full join o using (doc_id, tok_idx) group by 1",
    "label_distances": f"""with {RATINGS}, l as (select coder, item, list_sort(string_split(translate(label, '. ', '||'), '|')) as x from ratings where label is not null)
      select a.coder as coder_a, b.coder as coder_b, count(*) as n_items, round(avg(case when a.x = b.x then 0.0::double when list_has_any(a.x, b.x) then 0.5 else 1 end), 6) as distance from l a join l b on a.item = b.item and a.coder < b.coder group by 1, 2""",
    "top_labels": f"with {RATINGS}, n as (select coder, label, count(*) as n from ratings where label is not null group by 1, 2) select coder, label, n from (select *, row_number() over (partition by coder order by n desc, label) as k from n) where k <= 3",
    "ie_full_documents": f"""{_SENTS}, sz as (select doc_id, sent_idx, count(*) as n, min(tok) as lone from tokens group by 1, 2), kp as (select *, not (n = 1 and lone = '.') as keep, n = 1 and lone <> '.' as pad from sz),
      os as (select *, coalesce(sum(case when not keep then -1 when pad then 1 else 0 end) over (partition by doc_id order by sent_idx rows between unbounded preceding and 1 preceding), 0)::bigint as o from kp),
      k as (select * from os where keep), g as (select s.*, o from sents s join k using (doc_id, sent_idx)),
      a as (select distinct x.doc_id, x.span_id, x.first, x.last, x.o, x.label as r from g x join g e on e.doc_id = x.doc_id and e.span_id = x.span_id and e.sent_idx = x.sent_idx and e.annotator = 0 where x.annotator = 1),
      al as (select doc_id, span_id, string_agg(',[' || (first + o) || ',' || (last + o) || ',"' || r || '"]', '' order by first, last, r) as j from a group by 1, 2),
      e as (select g.doc_id, g.sent_idx, string_agg('[[' || (first + o) || ',' || (last + o) || ',"' || label || '"]' || coalesce(j, '') || ']', ',' order by first, last, g.span_id) as j from g left join al on al.doc_id = g.doc_id and al.span_id = g.span_id where annotator = 0 group by 1, 2),
      r as (select x.doc_id, x.sent_idx, string_agg('[' || x.first || ',' || x.last || ',' || (y.first + y.o) || ',' || (y.last + y.o) || ',"Pol.' || x.label || '"]', ',' order by x.first, x.last, y.first, y.last) as j from g x join g y on y.doc_id = x.doc_id and y.span_id = x.span_id and y.sent_idx = x.sent_idx and y.annotator = 2 where x.annotator = 1 group by 1, 2),
      w as (select doc_id, sent_idx, string_agg(to_json(tok)::varchar, ',' order by tok_idx) as j from tokens group by 1, 2),
      d as (select k.doc_id, string_agg('[' || w.j || case when pad then ',"."' else '' end || ']', ',' order by k.sent_idx) as s, string_agg('[' || coalesce(e.j, '') || ']', ',' order by k.sent_idx) as e, string_agg('[' || coalesce(r.j, '') || ']', ',' order by k.sent_idx) as r, string_agg('[]', ',') as z
        from k join w using (doc_id, sent_idx) left join e on e.doc_id = k.doc_id and e.sent_idx = k.sent_idx left join r on r.doc_id = k.doc_id and r.sent_idx = k.sent_idx group by 1)
      select doc_id::varchar as doc_key, '{{"doc_key":"' || doc_id || '","dataset":"data","sentences":[' || s || '],"events":[' || e || '],"ner":' || case when doc_id % 2 = 0 then '[[0,0,"N' || (select count(*) from sz where sz.doc_id = d.doc_id) || '"]]' else '[' || z || ']' end || ',"clusters":[' || z || '],"relations":[' || r || ']}}' as doc from d""",
    "tagged_triples": f"""{_SENTS}, pr as (select u.doc_id, u.sent_idx, t.span_id as target_id, u.label as sentiment, min(u.span_id) as fu, any_value(t.first) as tf, any_value(t.last) as tl from sents u join sents t on t.doc_id = u.doc_id and t.sent_idx = u.sent_idx where u.annotator = 0 and t.annotator = 1 group by 1, 2, 3, 4),
      n as (select *, row_number() over (partition by doc_id, sent_idx order by fu, target_id, sentiment) - 1 as n from pr),
      ot as (select s.doc_id, s.sent_idx, s.label, k.tok_idx, arg_max(case when k.tok_idx = s.first then 'B' else 'I' end, (s.first, s.span_id, s.last)) as tag from sents s join tokens k on k.doc_id = s.doc_id and k.tok_idx between s.first and s.last where s.annotator = 0 and s.sent_idx is not null group by 1, 2, 3, 4)
      select n.doc_id || ':' || n.sent_idx as id, string_agg(k.tok, ' ' order by k.tok_idx) as sentence, n.doc_id || ':' || n.sent_idx || '-' || n.n as uid, string_agg(k.tok || '\\' || case when k.tok_idx = tf then 'B' when k.tok_idx between tf and tl then 'I' else 'O' end, ' ' order by k.tok_idx) as target_tags,
        string_agg(k.tok || '\\' || coalesce(ot.tag, 'O'), ' ' order by k.tok_idx) as opinion_tags, n.sentiment
      from n join tokens k on k.doc_id = n.doc_id and k.sent_idx = n.sent_idx left join ot on ot.doc_id = n.doc_id and ot.sent_idx = n.sent_idx and ot.label = n.sentiment and ot.tok_idx = k.tok_idx group by n.doc_id, n.sent_idx, n.n, n.sentiment""",
    "polar_rows": f"""{_SENTS}, st as (select doc_id, sent_idx, min(tok_idx) as start, string_agg(tok, ' ' order by tok_idx) as sentence from tokens group by 1, 2),
      tg as (select distinct s.doc_id, s.sent_idx, s.first, s.last, start from sents s join st using (doc_id, sent_idx) where annotator = 1), ta as (select doc_id, sent_idx, min(first) as tf, max(last) as tl, string_agg('(' || (first - start) || ', ' || (last - start) || ')', ', ' order by first, last) as spans from tg group by 1, 2),
      u as (select s.*, start, sentence, least(s.first, tf) as lo, greatest(s.last, tl) as hi, spans, row_number() over (partition by s.doc_id, s.sent_idx order by s.first, s.last, s.span_id) - 1 as n from sents s join st using (doc_id, sent_idx) left join ta using (doc_id, sent_idx) where annotator = 0)
      select printf('%d %02d %02d', u.doc_id, u.sent_idx, n) as id, label as polarity, label as polarity_orig, any_value(sentence) as sentence, string_agg(k.tok, ' ' order by k.tok_idx) filter (k.tok_idx between u.first and u.last) as polex, string_agg(k.tok, ' ' order by k.tok_idx) as polex_targets,
        '(' || (u.first - start) || ', ' || (u.last - start) || ')' as polex_span, '(' || (lo - start) || ', ' || (hi - start) || ')' as polex_targets_span, '[' || coalesce(any_value(spans), '') || ']' as target_spans, case when u.doc_id % 3 = 0 then 'dev' else 'train' end as split
      from u join tokens k on k.doc_id = u.doc_id and k.tok_idx between lo and hi group by u.doc_id, u.sent_idx, n, label, u.first, u.last, start, lo, hi""",
    "texts_repeated": f"{_X}, p as (select text, doc_uid || '-' || element_id as place from el where layer = 'participant' and text is not null) select * from (select text, place, count(*) over (partition by text) as n from p) where n > 1",
    "texts_shortened": f"{_X} select case when length(text) > 15 then left(text, 6) || '...' || right(text, 6) else text end as short, count(*) as n from el group by 1",
    "span_gaps": f"with {SPANS} select greatest(0, b.first - a.last, a.first - b.last) as gap, count(*) as n from spans a join spans b on a.doc_id = b.doc_id and a.span_id = b.span_id where a.annotator = 1 and b.annotator = 2 group by 1",
    "pronominal_units": f"{_T} select doc_uid, element_id from pron",
    "pairwise_prf_mean": f"""with {RATINGS}, pr as (select x.coder as a, y.coder as b, x.label as la, y.label as lb from complete x join complete y using (item) where x.coder < y.coder),
      k as (select a, b, la as label from pr union select a, b, lb from pr), t as (select k.a, k.b, k.label, count(*) filter (la = k.label) as na, count(*) filter (lb = k.label) as nb, count(*) filter (la = k.label and lb = k.label) as tp from k join pr on pr.a = k.a and pr.b = k.b group by 1, 2, 3),
      s as (select label, coalesce(tp::double / nullif(nb, 0), 0) as p, coalesce(tp::double / nullif(na, 0), 0) as r, coalesce(2.0::double * tp / nullif(na + nb, 0), 0) as f from t union all select null, x, x, x from (select avg((la = lb)::int) as x from pr group by a, b))
      select label, count(*) as n_pairs, round(avg(p), 6) as precision, round(avg(r), 6) as recall, round(avg(f), 6) as f1 from s group by 1""",
}
