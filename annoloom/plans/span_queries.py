"""Matching, scoring, alignment and exports over the spans view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, export, matching, quality, scoring, stats
from ..operators import spans as sp
from ..session import stored
from .adapters import SPANS, TOKENS, spans, tokens

ATTRIBUTES = ["label", "parity"]
METRICS = ["p", "r", "f1", "p_relaxed", "r_relaxed", "f1_relaxed", "p_attrib", "r_attrib", "f1_attrib", "acc_label", "acc_parity", "acc_allattrib"]
KEYWORDS = {"positive": ["growth", "profit", "rose"], "negative": ["fell", "costs", "weak"]}
CASCADE = ("span", "sentence", 25, "document")
CUES = {"positive": ["good", "rose"], "negative": ["bad", "fell"], "neutral": ["said"]}


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = stored(spans(spark, sf_dir)).withColumn("parity", (F.col("last") - F.col("first")) % 2)
    gold = s.filter("annotator = 0").drop("annotator").withColumnRenamed("span_id", "gold_id")
    return gold, s.filter("annotator > 0").withColumnRenamed("span_id", "sys_id")


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, system = _sides(spark, sf_dir)
    return scoring.nugget_sums(gold, system, matching.match(gold, system), ATTRIBUTES)


def _six(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def ere_match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(scoring.prf(_sums(spark, sf_dir), ATTRIBUTES))


def ere_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(matching.match(*_sides(spark, sf_dir)))


def overlap_candidates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(matching.overlap_candidates(*_sides(spark, sf_dir)))


def mutual_max_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(matching.mutual_best(matching.overlap_candidates(*_sides(spark, sf_dir))))


def matches_taken_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, system = _sides(spark, sf_dir)
    return _six(matching.taken_once(gold, matching.overlap_candidates(gold, system)))


def attribute_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _sums(spark, sf_dir).groupBy("annotator").agg(*(F.sum(c).alias(c) for c in ("n_gold", "n_system", "acc_label", "acc_parity", "acc_allattrib")))
    return sums.select("annotator", "n_gold", "n_system", *(F.round(F.col(c) / F.col("n_system"), 6).alias(c) for c in ("acc_label", "acc_parity", "acc_allattrib")))


def macro_scores_by_annotator_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(scoring.mean_scores(scoring.prf(_sums(spark, sf_dir), ATTRIBUTES), METRICS))


def corpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(scoring.corpus_scores(_sums(spark, sf_dir)))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, system = _sides(spark, sf_dir)
    return _six(scoring.confusion(gold, system, matching.match(gold, system)))


def _typed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    toks = tokens(spark, sf_dir)
    gold, system = _sides(spark, sf_dir)
    g, s = sp.sentence_of_spans(gold, toks), sp.sentence_of_spans(system, toks)
    return gold, system, matching.same_type_in_window(g, s)


def type_window_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _typed(spark, sf_dir)[2]
    return pairs.groupBy("annotator", "label").agg(F.count("*").alias("n"), F.min("token_distance").cast("long").alias("nearest"), F.max("token_distance").cast("long").alias("farthest"), F.sum("token_distance").alias("total_distance"))


def strategy_cascade_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = tokens(spark, sf_dir)
    s = sp.sentence_of_spans(spans(spark, sf_dir), toks)
    words = sp.tokens_in_spans(toks.select("doc_id", "tok_idx", "tok"), s.select("doc_id", "annotator", "span_id", "first", "last"), ["doc_id"]).groupBy("doc_id", "annotator", "span_id").agg(F.collect_list("tok").alias("words"))
    worded = stored(s.join(words, ["doc_id", "annotator", "span_id"]))
    gold = worded.filter("annotator = 0").drop("annotator").withColumnRenamed("span_id", "gold_id")
    return matching.cascade(gold, worded.filter("annotator > 0").withColumnRenamed("span_id", "sys_id"), CASCADE)


def full_outer_missing_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    left = s.filter("annotator = 0").select("doc_id", F.col("span_id").alias("left_id"), F.col("label").alias("left_label"))
    right = s.filter("annotator = 1").select("doc_id", F.col("span_id").alias("right_id"), F.col("label").alias("right_label"))
    gold, system = _sides(spark, sf_dir)
    pairs = matching.overlap_candidates(gold, system.filter("annotator = 1")).select("doc_id", F.col("gold_id").alias("left_id"), F.col("sys_id").alias("right_id"))
    return matching.with_missing(left, right, pairs).groupBy("left_label", "right_label").agg(F.count("*").alias("n"))


def exact_overlap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    groups = sp.exact_overlaps(s, ["doc_id", "annotator"]).groupBy("annotator").agg(F.count("*").alias("n_groups"), F.sum("n_spans").alias("n_in_groups"))
    total = s.groupBy("annotator").agg(F.count("*").alias("n_spans"))
    joined = total.join(groups, "annotator", "left")
    return joined.select("annotator", "n_spans", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce("n_in_groups", F.lit(0)).alias("n_in_groups"), F.round(100.0 * F.coalesce("n_in_groups", F.lit(0)) / F.col("n_spans"), 1).alias("pct"))


def span_union_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = alignment.unit_groups(spans(spark, sf_dir))
    return grouped.groupBy("doc_id", "group_no").agg(F.count("*").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("self_overlap").alias("self_overlap"))


def self_overlap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = alignment.unit_groups(spans(spark, sf_dir)).filter("self_overlap")
    return grouped.groupBy("doc_id").agg(F.countDistinct("group_no").alias("n_groups"), F.count("*").alias("n_spans"))


def self_overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.resolved_groups(spans(spark, sf_dir))


def overlap_rating_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_matrix(spans(spark, sf_dir), [0, 1, 2], "Missing")


def token_label_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = export.token_labels(tokens(spark, sf_dir), spans(spark, sf_dir), [0, 1, 2])
    return labels.groupBy("annotator_0", "annotator_1", "annotator_2").agg(F.count("*").alias("n"), F.sum("tok_idx").alias("places"))


def gamma_export_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokens(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_tokens"))
    return export.corpus_offsets(docs, spans(spark, sf_dir))


def bio_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.bio_text(tokens(spark, sf_dir), spans(spark, sf_dir).filter("annotator = 0").withColumn("ord", F.col("span_id")), ["doc_id"], "ord")


def _units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = sp.sentence_of_spans(spans(spark, sf_dir), tokens(spark, sf_dir))
    return s.filter("annotator = 0"), s.filter("annotator = 1")


def opinion_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.triples(*_units(spark, sf_dir)).drop("opinion_ids")


def polar_instances_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.polar_instances(*_units(spark, sf_dir))


def ie_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = tokens(spark, sf_dir)
    return export.ie_documents(toks, sp.sentence_of_spans(spans(spark, sf_dir).filter("annotator = 0"), toks))


def sentence_padding_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.sentence_offsets(tokens(spark, sf_dir))


def false_discontinuity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.merge_touching(spans(spark, sf_dir), ["doc_id", "annotator"])


def capped_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    core, parts = _units(spark, sf_dir)
    part = parts.groupBy("doc_id", "sent_idx").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("parts"))
    joined = core.join(part, ["doc_id", "sent_idx"])
    return joined.select("doc_id", "span_id", sp.capped_extension(F.col("first"), F.col("last"), F.col("parts"), 24).alias("s")).select("doc_id", "span_id", "s.first", "s.last")


def cross_sentence_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.crossing_pairs(*_units(spark, sf_dir))


def sentence_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sp.sentence_of_spans(spans(spark, sf_dir), tokens(spark, sf_dir))
    return s.groupBy("annotator", "label").agg(F.count("sent_idx").alias("n_inside"), F.count_if(F.col("sent_idx").isNull()).alias("n_crossing"), F.sum("sent_idx").alias("sents"))


def token_containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = sp.tokens_in_spans(tokens(spark, sf_dir), spans(spark, sf_dir), ["doc_id"])
    return joined.groupBy("doc_id", "annotator").agg(F.count("*").alias("n"), F.countDistinct("tok_idx").alias("n_tokens"), F.min("tok").alias("least_tok"))


def span_length_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = spans(spark, sf_dir).select("annotator", (F.col("last") - F.col("first") + 1).alias("n_tokens"))
    return _six(stats.percentile_ranks(lengths, "n_tokens", ["annotator"]))


def span_length_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(quality.length_counts(spans(spark, sf_dir), ["annotator", "label"]))


def unit_counts_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import table

    return _six(stats.count_avg(table(spark, sf_dir, "documents"), spans(spark, sf_dir), "doc_id"))


def low_density_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(quality.low_density(tokens(spark, sf_dir), spans(spark, sf_dir).filter("annotator = 0")))


def polarity_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = sp.tokens_in_spans(tokens(spark, sf_dir), spans(spark, sf_dir).filter("annotator = 0"), ["doc_id"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "tok"))), lambda x: x["tok"]), " ")
    units = marked.groupBy("doc_id", "span_id", "label").agg(text.alias("text"))
    return quality.cue_mismatches(units, "text", "label", CUES).select("doc_id", "span_id", "label", "cue_label")


def keyword_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = sp.span_tokens(spans(spark, sf_dir).filter("annotator = 0"))
    return quality.keywords_missed(tokens(spark, sf_dir), covered, KEYWORDS)


def error_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    errors = s.filter("annotator = 2").select("doc_id", F.col("first").alias("pred_ix"), F.col("label").alias("pred_label"))
    refs = s.filter("annotator = 0").select("doc_id", "first", "last", F.col("label").alias("ref_label"))
    return quality.error_in_reference(errors, refs, "doc_id").groupBy("pred_label", "ref_label").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        ere_match_scores, ere_matches, overlap_candidates_all, mutual_max_match, matches_taken_once, attribute_accuracy, macro_scores_by_annotator_doc, corpus_scores, confusion_matrix,
        type_window_candidates, strategy_cascade_match, full_outer_missing_ratings, exact_overlap_stats, span_union_groups, self_overlap_groups, self_overlap_resolution, overlap_rating_matrix,
        token_label_matrix, gamma_export_offsets, bio_tags, opinion_triples, polar_instances_hull, ie_nested_json, sentence_padding_offsets, false_discontinuity_merge, capped_extension,
        cross_sentence_removed, sentence_containment, token_containment_join, span_length_percentile, span_length_counts, unit_counts_avg, low_density_docs, polarity_mismatch, keyword_missed, error_range_join,
    )
}

_W = f"with {SPANS}, "
_CAND = """cand as (
  select g.doc_id, s.annotator, g.span_id as gold_id, s.span_id as sys_id, 2.0::double * count(*) / (any_value(g.last - g.first + 1) + any_value(s.last - s.first + 1)) as dice
  from (select * from span_tokens where annotator = 0) g join (select * from span_tokens where annotator > 0) s using (doc_id, tok_idx) group by 1, 2, 3, 4),
matches as (select * exclude (r) from (select *, rank() over (partition by doc_id, annotator, gold_id order by dice desc) as r
  from (select * exclude (n) from (select *, row_number() over (partition by doc_id, annotator, sys_id order by gold_id) as n from cand) where n = 1)) where r = 1)"""
_SUMS = """rows_ as (
  select m.*, (g.label = s.label and (g.last - g.first) % 2 = (s.last - s.first) % 2) as h_all, g.label = s.label as h_label, (g.last - g.first) % 2 = (s.last - s.first) % 2 as h_parity
  from matches m join spans g on g.doc_id = m.doc_id and g.annotator = 0 and g.span_id = m.gold_id join spans s on s.doc_id = m.doc_id and s.annotator = m.annotator and s.span_id = m.sys_id),
golds as (
  select doc_id, annotator, gold_id, count(*) as k, max(dice) as d, arg_min(h_all, sys_id) as first_hit, sum(h_all::int)::double as c_all, sum(h_label::int)::double as c_label, sum(h_parity::int)::double as c_parity,
    sum(case when h_label then dice else 0 end) as d_label, sum(case when h_parity then dice else 0 end) as d_parity from rows_ group by 1, 2, 3),
base as (
  select x.doc_id, x.annotator, x.n_system, g.span_id as gold_id, k, d, coalesce(first_hit, false) as first_hit, c_all, c_label, c_parity, d_label, d_parity
  from (select doc_id, annotator, count(*) as n_system from spans where annotator > 0 group by 1, 2) x join spans g on g.doc_id = x.doc_id and g.annotator = 0
  left join golds on golds.doc_id = x.doc_id and golds.annotator = x.annotator and golds.gold_id = g.span_id),
sums as (
  select doc_id, annotator, count(*) as n_gold, max(n_system) as n_system, sum(coalesce(d, 0))::double as tp, sum((k is null)::int)::double as fp, sum((k is not null)::int)::double as tp_relaxed,
    sum(case when first_hit then d else 0 end)::double as tp_attrib, sum(first_hit::int)::double as tp_attrib_relaxed, sum((not first_hit)::int)::double as fp_attrib,
    sum(coalesce(c_all / k, 0))::double as acc_allattrib, sum(coalesce(d_label, 0))::double as tp_label, sum(coalesce(d_parity, 0))::double as tp_parity, sum(coalesce(c_label / k, 0))::double as acc_label, sum(coalesce(c_parity / k, 0))::double as acc_parity
  from base group by 1, 2)"""


# Self-overlaps resolved: cells of greatest dice tie units, tied units are parts, of an annotator's several units in a part one stays.
_RESOLVED = """flagged as (select *, row_number() over (partition by doc_id, group_no order by first, last, annotator, span_id) as i from grouped where self_overlap),
cells as (select x.doc_id, x.group_no, x.annotator as a, y.annotator as b, x.i, y.i as j, x.label = y.label as same, 2.0::double * greatest(0, least(x.last, y.last) - greatest(x.first, y.first) + 1) / (x.last - x.first + y.last - y.first + 2) as dice from flagged x join flagged y on x.doc_id = y.doc_id and x.group_no = y.group_no and x.annotator < y.annotator),
tops as (select *, max(dice) over w as top, min(dice) over w as low, count(*) over w as n from cells window w as (partition by doc_id, group_no, a, b)),
ties as (select doc_id, group_no, i, j from tops where dice = top and top > 0 and (n = 1 or top > low or same)),
both_ways as (select * from ties union all select doc_id, group_no, j, i from ties),
reach(doc_id, group_no, i, j) as (select doc_id, group_no, i, i from flagged union select r.doc_id, r.group_no, r.i, t.j from reach r join both_ways t on t.doc_id = r.doc_id and t.group_no = r.group_no and t.i = r.j),
comps as (select doc_id, group_no, i, min(j) as comp from reach group by 1, 2, 3),
placed as (select f.*, comp from flagged f join comps using (doc_id, group_no, i)),
means as (select x.doc_id, x.group_no, x.i, coalesce(avg(c.dice), 0) as mean from placed x left join placed y on y.doc_id = x.doc_id and y.group_no = x.group_no and y.comp = x.comp and y.annotator <> x.annotator
  left join cells c on c.doc_id = x.doc_id and c.group_no = x.group_no and c.i = case when x.annotator < y.annotator then x.i else y.i end and c.j = case when x.annotator < y.annotator then y.i else x.i end group by 1, 2, 3),
chosen as (select p.*, row_number() over (partition by doc_id, group_no, comp, annotator order by mean desc, i) as place from placed p join means using (doc_id, group_no, i)),
keyed as (select *, min(i) over (partition by doc_id, group_no, case when place = 1 then comp else -i end) as lead from chosen),
parts as (select *, dense_rank() over (partition by doc_id, group_no order by lead) as part_no from keyed),
resolved as (select doc_id, annotator, span_id, first, last, label, doc_id || '_' || group_no as group_id from grouped where not self_overlap union all select doc_id, annotator, span_id, first, last, label, doc_id || '_' || group_no || '_' || part_no from parts)"""


def _q(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif(({b})::double, 0), 0)"


def _prf_sql() -> str:
    cols = {"r": _q("tp", "n_gold"), "p": _q("tp", "tp + fp"), "p_alt": _q("tp", "n_system")}
    for m in ("relaxed", "attrib", "attrib_relaxed", *ATTRIBUTES):
        cols |= {f"r_{m}": _q(f"tp_{m}", "n_gold"), f"p_{m}": _q(f"tp_{m}", f"tp_{m} + fp"), f"p_{m}_alt": _q(f"tp_{m}", "n_system")}
    for name in [k for k in cols if k[0] == "p"]:
        r = cols["r" + name[1:].removesuffix("_alt")]
        cols["f1" + name[1:]] = _q(f"2 * {cols[name]} * {r}", f"{cols[name]} + {r}")
    for m in ("allattrib", *ATTRIBUTES):
        cols[f"acc_{m}"] = _q(f"acc_{m}", "n_system")
    return "prf as (select doc_id, annotator, n_gold, n_system, " + ", ".join(f"{v} as {k}" for k, v in cols.items()) + " from sums)", list(cols)


_PRF, _PRF_COLS = _prf_sql()
_ALL = f"{_W}{_CAND}, {_SUMS}, {_PRF} "
_SENT = f"with {TOKENS}, {SPANS}, sents as (select s.*, case when a.sent_idx = b.sent_idx then a.sent_idx end as sent_idx from spans s left join tokens a on a.doc_id = s.doc_id and a.tok_idx = s.first left join tokens b on b.doc_id = s.doc_id and b.tok_idx = s.last)"
_GROUPS = """flags as (select *, max(last + 1) over (partition by doc_id order by first, last + 1, annotator, span_id rows between unbounded preceding and 1 preceding) as reach from spans),
numbered as (select *, sum(case when reach is null or first >= reach then 1 else 0 end) over (partition by doc_id order by first, last + 1, annotator, span_id rows between unbounded preceding and current row)::bigint as group_no from flags),
grouped as (select *, max(own) over (partition by doc_id, group_no) > 1 as self_overlap from (select *, count(*) over (partition by doc_id, group_no, annotator) as own from numbered))"""

ORACLES = {
    "ere_match_scores": _ALL + "select doc_id, annotator, n_gold, n_system, " + ", ".join(f"round({c}, 6) as {c}" for c in _PRF_COLS) + " from prf",
    "ere_matches": f"{_W}{_CAND} select doc_id, annotator, gold_id, sys_id, round(dice, 6) as dice from matches",
    "overlap_candidates_all": f"{_W}{_CAND} select doc_id, annotator, gold_id, sys_id, round(dice, 6) as dice from cand",
    "mutual_max_match": f"{_W}{_CAND} select doc_id, annotator, gold_id, sys_id, round(dice, 6) as dice from (select *, max(dice) over (partition by doc_id, annotator, gold_id) as r, max(dice) over (partition by doc_id, annotator, sys_id) as c from cand) where dice = r and dice = c",
    "matches_taken_once": f"""{_W}{_CAND}, places as (select doc_id, span_id as gold_id, row_number() over (partition by doc_id, first, last order by span_id) as place from spans where annotator = 0),
      ties as (select *, row_number() over (partition by doc_id, annotator, gold_id order by sys_id) as tie, count(*) over (partition by doc_id, annotator, gold_id) as n_ties from (select *, rank() over (partition by doc_id, annotator, gold_id order by dice desc) as r from cand) where r = 1),
      picked as (select t.*, row_number() over (partition by doc_id, annotator, sys_id order by gold_id) as n from ties t join places using (doc_id, gold_id) where tie = least(place, n_ties))
      select doc_id, annotator, gold_id, sys_id, round(dice, 6) as dice from picked where n = 1""",
    "attribute_accuracy": _ALL + "select annotator, sum(n_gold)::bigint as n_gold, sum(n_system)::bigint as n_system, round(sum(acc_label) / sum(n_system), 6) as acc_label, round(sum(acc_parity) / sum(n_system), 6) as acc_parity, round(sum(acc_allattrib) / sum(n_system), 6) as acc_allattrib from sums group by 1",
    "macro_scores_by_annotator_doc": _ALL + "select case when grouping(annotator) = 0 then 'annotator' when grouping(doc_id) = 0 then 'doc' else 'all' end as level, annotator, doc_id, count(*) as n, " + ", ".join(f"round(avg({c}), 6) as {c}" for c in METRICS) + " from prf group by grouping sets ((), (annotator), (doc_id))",
    "corpus_scores": _ALL + f""", t as (select annotator, sum(n_gold)::bigint as n_gold, sum(n_system)::bigint as n_system, sum(tp) as tp, sum(fp) as fp, sum(tp_relaxed) as tp_relaxed, sum(tp_attrib) as tp_attrib, sum(fp_attrib) as fp_attrib, sum(acc_allattrib) as acc_allattrib from sums group by 1),
      u as (select *, {_q("tp", "tp + fp")} as p, {_q("tp", "n_gold")} as r, {_q("tp_attrib", "tp_attrib + fp_attrib")} as pa, {_q("tp_attrib", "n_gold")} as ra from t)
      select annotator, n_gold, n_system, round(tp_relaxed, 6) as n_matched, round(p, 6) as p, round(r, 6) as r, round({_q("2 * p * r", "p + r")}, 6) as f1, round(pa, 6) as p_attrib, round(ra, 6) as r_attrib, round({_q("2 * pa * ra", "pa + ra")}, 6) as f1_attrib,
      round({_q("acc_allattrib", "tp_relaxed")}, 6) as acc_allattrib, round({_q("tp_relaxed", "n_gold")}, 6) as matched_share from u""",
    "confusion_matrix": f"""{_W}{_CAND}, firsts as (select doc_id, annotator, gold_id, min(sys_id) as sys_id from matches group by 1, 2, 3),
      base as (select x.annotator, g.label as gold_label, coalesce(s.label, 'None') as sys_label from (select distinct doc_id, annotator from spans where annotator > 0) x join spans g on g.doc_id = x.doc_id and g.annotator = 0
        left join firsts f on f.doc_id = x.doc_id and f.annotator = x.annotator and f.gold_id = g.span_id left join spans s on s.doc_id = x.doc_id and s.annotator = x.annotator and s.span_id = f.sys_id)
      select annotator, gold_label, sys_label, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by annotator, gold_label), 6) as row_share from base group by 1, 2, 3""",
    "type_window_candidates": f"{_SENT} select s.annotator, g.label, count(*) as n, min(greatest(g.first - s.last, s.first - g.last))::bigint as nearest, max(greatest(g.first - s.last, s.first - g.last))::bigint as farthest, sum(greatest(g.first - s.last, s.first - g.last))::bigint as total_distance from sents g join sents s on g.doc_id = s.doc_id and g.label = s.label and g.sent_idx = s.sent_idx where g.annotator = 0 and s.annotator > 0 group by 1, 2",
    "strategy_cascade_match": f"""{_SENT}, {_CAND},
      words as (select doc_id, annotator, span_id, list(tok) as words from span_tokens join tokens using (doc_id, tok_idx) group by 1, 2, 3),
      w as (select sents.*, words from sents join words using (doc_id, annotator, span_id)),
      wanted as (select g.doc_id, x.annotator, g.span_id as gold_id, g.label, g.sent_idx, g.first, g.last, g.words from w g join (select distinct doc_id, annotator from w where annotator > 0) x on g.doc_id = x.doc_id where g.annotator = 0),
      one as (select doc_id, annotator, gold_id, sys_id, 'span' as how from (select *, row_number() over (partition by doc_id, annotator, gold_id order by dice desc, sys_id) as n from cand) where n = 1),
      pairs as (select g.doc_id, g.annotator, g.gold_id, s.span_id as sys_id, coalesce(g.sent_idx = s.sent_idx, false) as same_sentence, greatest(g.first - s.last, s.first - g.last) as dist,
          case when list_sort(g.words) = list_sort(s.words) then 1.0::double else 2.0::double * len(list_intersect(g.words, s.words)) / (len(g.words) + len(s.words)) end as dice
        from wanted g join w s on s.doc_id = g.doc_id and s.annotator = g.annotator and s.label = g.label
        where not exists (select 1 from one o where o.doc_id = g.doc_id and o.annotator = g.annotator and o.gold_id = g.gold_id)),
      tiers as (select *, case when same_sentence then 1 when dist <= 25 then 2 else 3 end as own from pairs),
      first_tier as (select *, min(own) over (partition by doc_id, annotator, gold_id) as tier from tiers),
      in_tier as (select *, row_number() over (partition by doc_id, annotator, gold_id order by dice desc, dist, sys_id) as n from first_tier where (tier = 1 and same_sentence) or (tier = 2 and dist <= 25) or tier = 3)
      select * from one union all select doc_id, annotator, gold_id, sys_id, ['sentence', 'window', 'document'][tier] as how from in_tier where n = 1""",
    "full_outer_missing_ratings": f"""{_W}{_CAND}, l as (select doc_id, span_id as left_id, label as left_label from spans where annotator = 0), r as (select doc_id, span_id as right_id, label as right_label from spans where annotator = 1),
      p as (select doc_id, gold_id as left_id, sys_id as right_id from cand where annotator = 1)
      select coalesce(left_label, 'NaN') as left_label, coalesce(right_label, 'NaN') as right_label, count(*) as n from (select l.*, p.right_id as rid from l left join p using (doc_id, left_id)) x full join r on r.doc_id = x.doc_id and r.right_id = x.rid group by 1, 2""",
    "exact_overlap_stats": f"{_W} g as (select annotator, count(*) as n_groups, sum(c)::bigint as n_in from (select doc_id, annotator, first, last, count(*) as c from spans group by all having count(*) > 1) group by 1) select s.annotator, s.n as n_spans, coalesce(n_groups, 0) as n_groups, coalesce(n_in, 0) as n_in_groups, round(100.0::double * coalesce(n_in, 0) / s.n, 1) as pct from (select annotator, count(*) as n from spans group by 1) s left join g using (annotator)",
    "span_union_groups": f"{_W}{_GROUPS} select doc_id, group_no, count(*) as n, min(first) as first, max(last) as last, bool_or(self_overlap) as self_overlap from grouped group by 1, 2",
    "self_overlap_groups": f"{_W}{_GROUPS} select doc_id, count(distinct group_no) as n_groups, count(*) as n_spans from grouped where self_overlap group by 1",
    "token_label_matrix": f"with {TOKENS}, {SPANS}, m as (select doc_id, tok_idx, annotator, min(label) as label from span_tokens group by 1, 2, 3) select coalesce(a.label, 'no_anno') as annotator_0, coalesce(b.label, 'no_anno') as annotator_1, coalesce(c.label, 'no_anno') as annotator_2, count(*) as n, sum(t.tok_idx)::bigint as places from tokens t left join m a on a.doc_id = t.doc_id and a.tok_idx = t.tok_idx and a.annotator = 0 left join m b on b.doc_id = t.doc_id and b.tok_idx = t.tok_idx and b.annotator = 1 left join m c on c.doc_id = t.doc_id and c.tok_idx = t.tok_idx and c.annotator = 2 group by 1, 2, 3",
    "gamma_export_offsets": f"{_W} o as (select doc_id, coalesce(sum(n + 10) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as off from span_docs where n > 0) select doc_id, annotator, span_id, label, first + off as begin, last + 1 + off as end from spans join o using (doc_id)",
    "bio_tags": f"with {TOKENS}, {SPANS}, m as (select doc_id, tok_idx, arg_max(case when tok_idx = first then 'B' else 'I' end, span_id) as tag from span_tokens where annotator = 0 group by 1, 2) select doc_id, string_agg(tok || '\\' || coalesce(tag, 'O'), ' ' order by tok_idx) as bio from tokens left join m using (doc_id, tok_idx) group by 1",
    "opinion_triples": f"{_SENT}, u as (select * from sents where annotator = 0 and sent_idx is not null), t as (select * from sents where annotator = 1), p as (select u.doc_id, u.sent_idx, t.span_id as target_id, u.label as sentiment, min(u.span_id) as first_unit, count(distinct u.span_id) as n_opinions from u join t using (doc_id, sent_idx) group by 1, 2, 3, 4) select doc_id, sent_idx, (row_number() over (partition by doc_id, sent_idx order by first_unit, target_id, sentiment) - 1)::integer as triple_no, target_id, sentiment, n_opinions from p",
    "polar_instances_hull": f"{_SENT}, h as (select doc_id, sent_idx, min(first) as tf, max(last) as tl from sents where annotator = 1 group by 1, 2), u as (select *, row_number() over (partition by doc_id, sent_idx order by first, last, span_id) - 1 as k from sents where annotator = 0 and sent_idx is not null) select u.doc_id::varchar || lpad(u.sent_idx::varchar, 4, '0') || lpad(k::varchar, 4, '0') as instance_id, u.doc_id, u.sent_idx, label, first, last, least(first, tf) as hull_first, greatest(last, tl) as hull_last from u left join h using (doc_id, sent_idx)",
    "sentence_padding_offsets": f"with {TOKENS}, s as (select doc_id, sent_idx, count(*) as n_tokens, not (count(*) = 1 and min(tok) = '.') as keep from tokens group by 1, 2), t as (select *, (n_tokens = 1 and keep) as pad from s) select *, coalesce(sum(case when not keep then -1 when pad then 1 else 0 end) over (partition by doc_id order by sent_idx rows between unbounded preceding and 1 preceding), 0)::bigint as offset from t",
    "false_discontinuity_merge": f"{_W} f as (select *, max(last) over (partition by doc_id, annotator order by first, last rows between unbounded preceding and 1 preceding) as reach from spans), n as (select *, sum(case when reach is null or first > reach + 1 then 1 else 0 end) over (partition by doc_id, annotator order by first, last rows between unbounded preceding and current row)::bigint as part_no from f) select doc_id, annotator, part_no, min(first) as first, max(last) as last, count(*) as n_parts from n group by 1, 2, 3",
    "capped_extension": f"""{_SENT}, p as (select doc_id, sent_idx, list(distinct {{'first': first, 'last': last}}) as parts from sents where annotator = 1 and sent_idx is not null group by 1, 2),
      x as (select c.doc_id, c.span_id, list_reduce(list_concat([{{'first': c.first, 'last': c.last}}], list_sort(parts)), lambda acc, q: case when greatest(0, q.first - acc.last, acc.first - q.last) + q.last - q.first + 1 < 24 then {{'first': least(acc.first, q.first), 'last': greatest(acc.last, q.last)}} else acc end) as s
        from sents c join p on p.doc_id = c.doc_id and p.sent_idx = c.sent_idx where c.annotator = 0) select doc_id, span_id, s.first as first, s.last as last from x""",
    "ie_nested_json": f"""with {TOKENS}, {SPANS}, sents as (select s.*, case when a.sent_idx = b.sent_idx then a.sent_idx end as sent_idx from spans s left join tokens a on a.doc_id = s.doc_id and a.tok_idx = s.first left join tokens b on b.doc_id = s.doc_id and b.tok_idx = s.last),
      sz as (select doc_id, sent_idx, count(*) as n, min(tok) as lone, string_agg(to_json(tok)::varchar, ',' order by tok_idx) as j from tokens group by 1, 2), kp as (select *, not (n = 1 and lone = '.') as keep, n = 1 and lone <> '.' as pad from sz),
      os as (select *, coalesce(sum(case when not keep then -1 when pad then 1 else 0 end) over (partition by doc_id order by sent_idx rows between unbounded preceding and 1 preceding), 0)::bigint as o from kp),
      e as (select s.doc_id, s.sent_idx, string_agg('{{"first":' || (first + o) || ',"last":' || (last + o) || ',"label":"' || label || '"}}', ',' order by first, last, label) as j from sents s join os on os.doc_id = s.doc_id and os.sent_idx = s.sent_idx where annotator = 0 and keep group by 1, 2)
      select k.doc_id as doc_key, '{{"doc_key":"' || k.doc_id || '","sentences":[' || string_agg('[' || k.j || case when pad then ',"."' else '' end || ']', ',' order by k.sent_idx) || '],"events":[' || string_agg('[' || coalesce(e.j, '') || ']', ',' order by k.sent_idx) || ']}}' as doc
      from os k left join e on e.doc_id = k.doc_id and e.sent_idx = k.sent_idx where keep group by 1""",
    "self_overlap_resolution": f"with recursive {_W[5:]}{_GROUPS}, {_RESOLVED} select * from resolved",
    "overlap_rating_matrix": f"with recursive {_W[5:]}{_GROUPS}, {_RESOLVED} select group_id, coalesce(max(label) filter (annotator = 0), 'Missing') as annotator_0, coalesce(max(label) filter (annotator = 1), 'Missing') as annotator_1, coalesce(max(label) filter (annotator = 2), 'Missing') as annotator_2 from resolved group by 1",
    "cross_sentence_removed": f"{_SENT}, u as (select * from sents where annotator = 0), t as (select * from sents where annotator = 1) select u.doc_id, count(*) filter (u.sent_idx = t.sent_idx) as n_kept, count(*) - count(*) filter (u.sent_idx = t.sent_idx) as n_removed from u join t on u.doc_id = t.doc_id group by 1",
    "sentence_containment": f"{_SENT} select annotator, label, count(sent_idx) as n_inside, count(*) filter (sent_idx is null) as n_crossing, sum(sent_idx)::bigint as sents from sents group by 1, 2",
    "token_containment_join": f"with {TOKENS}, {SPANS} select doc_id, annotator, count(*) as n, count(distinct tok_idx) as n_tokens, min(tok) as least_tok from span_tokens join tokens using (doc_id, tok_idx) group by 1, 2",
    "span_length_percentile": f"{_W} c as (select annotator, last - first + 1 as n_tokens, count(*) as n from spans group by 1, 2) select annotator, n_tokens, n, round(50.0::double * (2 * sum(n) over (partition by annotator order by n_tokens) - n + 1) / sum(n) over (partition by annotator), 6) as percentile from c",
    "span_length_counts": f"{_W} x as (select 1) select annotator, label, count(*) as n, count(*) filter (last > first) as n_multiword, round(avg(last - first + 1), 6) as mean_tokens from spans group by 1, 2",
    "unit_counts_avg": f"{_W} c as (select doc_id, count(*) as n from spans group by 1) select count(*) as n_docs, sum(coalesce(n, 0))::bigint as n_units, round(avg(coalesce(n, 0)), 6) as mean_units from documents left join c using (doc_id)",
    "low_density_docs": f"with {TOKENS}, {SPANS}, s as (select doc_id, max(sent_idx) + 1 as n_sentences from tokens group by 1), u as (select doc_id, count(*) as n from spans where annotator = 0 group by 1) select doc_id, n_sentences::bigint as n_sentences, coalesce(n, 0) as n_units, round(coalesce(n, 0)::double / n_sentences, 6) as density from s left join u using (doc_id) where coalesce(n, 0)::double / n_sentences <= 0.75",
    "polarity_mismatch": f"""with {TOKENS}, {SPANS}, u as (select doc_id, span_id, label, lower(string_agg(tok, ' ' order by tok_idx)) as text from span_tokens join tokens using (doc_id, tok_idx) where annotator = 0 group by 1, 2, 3),
      c as (select * from (values {", ".join(f"('{lb}', '{w}')" for lb, ws in CUES.items() for w in ws)}) v(cue_label, cue)) select distinct doc_id, span_id, label, cue_label from u join c on contains(text, cue) and cue_label <> label""",
    "keyword_missed": f"""with {TOKENS}, {SPANS}, k as (select * from (values {", ".join(f"('{lb}', '{w}')" for lb, ws in KEYWORDS.items() for w in ws)}) v(label, word)) select t.doc_id, k.label, count(*) as n_missed from tokens t join k on lower(regexp_replace(tok, '[^\\p{{L}}]', '', 'g')) = word
      where not exists (select 1 from span_tokens s where s.annotator = 0 and s.doc_id = t.doc_id and s.tok_idx = t.tok_idx and s.label = k.label) group by 1, 2""",
    "error_range_join": f"{_W} x as (select 1) select e.label as pred_label, r.label as ref_label, count(*) as n from spans e join spans r on e.doc_id = r.doc_id and e.first between r.first and r.last where e.annotator = 2 and r.annotator = 0 group by 1, 2",
}
