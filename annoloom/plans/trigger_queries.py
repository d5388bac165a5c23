"""Triggers, coreference closure, rankings and windows. Parts of speech are given by a rule on the token's place, as the tables hold none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import graph, matching, scoring, stats, triggers
from ..operators import spans as sp
from ..sources.tables import table
from .adapters import SPANS, TOKENS, spans, tokens
from .span_queries import _CAND, _sides, _six

POS = ("NOUN", "VERB", "DET", "ADP", "PROPN", "PUNCT", "AUX")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.element_at(F.array(*(F.lit(p) for p in POS)), F.expr("cast((doc_id * 3 + tok_idx * tok_idx) % 7 as int)") + 1)
    dep = F.when(F.col("tok_idx") % 4 == 0, "nsubj").when(F.col("tok_idx") % 5 == 0, "ROOT").otherwise("dep")
    head = F.col("tok_idx") + F.when(F.col("tok_idx") % 3 == 0, 1).otherwise(-1)
    return tokens(spark, sf_dir).select("doc_id", "tok_idx", "sent_idx", pos.alias("pos"), dep.alias("dep"), head.alias("head"))


KEYS = ["doc_id", "span_id"]


def best_trigger_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).filter("annotator = 0").select("doc_id", F.floor(F.col("span_id") / 20).alias("trigger"), F.col("span_id").alias("part_no"), "first", "last")
    return _six(triggers.best_run(s, _tagged(spark, sf_dir), ["doc_id", "trigger"], 16))


def _gold_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.tokens_in_spans(_tagged(spark, sf_dir), spans(spark, sf_dir).filter("annotator = 0"), ["doc_id"]).select(*KEYS, "tok_idx", "head", "pos", "dep")


def truncate_contentful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.truncate(_gold_tokens(spark, sf_dir), KEYS, 3)


def head_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.head_token(_gold_tokens(spark, sf_dir), KEYS)


def head_noun_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.head_token(_gold_tokens(spark, sf_dir), KEYS, noun=True)


def root_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of speech and dependencies of spans' roots, with their shares."""
    roots = triggers.with_root(_gold_tokens(spark, sf_dir), KEYS).filter("root")
    return _six(stats.shares(roots, ["pos", "dep"]))


def tag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of neighbouring tokens of a sentence as texts, put together element by element."""
    per = _tagged(spark, sf_dir).groupBy("doc_id", "sent_idx").agg(F.array_sort(F.collect_list(F.struct("tok_idx", "pos", "dep"))).alias("t"))
    joined = scalars.zip_text(F.transform("t", lambda x: x["pos"]), F.transform("t", lambda x: x["dep"]))
    return per.select(F.explode(joined).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def lists_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists written as text, some of them badly, read back."""
    text = F.when(F.col("p_size") % 5 == 0, F.lit("[broken")).otherwise(F.concat(F.lit("['"), "p_brand", F.lit("', '"), "p_type", F.lit("']")))
    read = table(spark, sf_dir, "part").select("p_partkey", scalars.safe_list(text).alias("l"))
    return read.select("p_partkey", F.size("l").alias("n"), F.get("l", F.lit(1)).alias("second"))


def _with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    parts = s.filter("annotator = 1").groupBy(*KEYS).agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("parts"))
    return s.filter("annotator = 0").join(parts, KEYS, "left")


def filled_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.trigger_span(_with_parts(spark, sf_dir), _tagged(spark, sf_dir), KEYS, distance=2)


def filled_with_all_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.trigger_span(_with_parts(spark, sf_dir), _tagged(spark, sf_dir), KEYS)


def cut_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.trigger_span(_with_parts(spark, sf_dir), _tagged(spark, sf_dir), KEYS, distance=2, width=4)


def noun_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.trigger_span(_with_parts(spark, sf_dir), _tagged(spark, sf_dir), KEYS, distance=2, head="head_noun")


def _coref(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs = table(spark, sf_dir, "canonrefs").filter("pronom_id <> 0 and referent_id <> 0").select("doc_uid", "pronom_id", "referent_id", "text")
    return pairs, graph.star_components(pairs, "pronom_id", "referent_id", ["doc_uid"])


def coref_closure_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that a group of mentions is called by, through all they are tied to; coref_closure_members has who is in it."""
    pairs, components = _coref(spark, sf_dir)
    closed = graph.component_values(components, pairs.withColumnRenamed("referent_id", "node"), ["doc_uid"], "node", "text")
    return closed.select("doc_uid", "component", F.array_join("values", "|").alias("texts"))


def coref_closure_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coref(spark, sf_dir)[1].withColumnRenamed("group", "component")


def label_score_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, system = _sides(spark, sf_dir)
    return _six(scoring.ranked_by_type(matching.match(gold, system), gold))


def spurious_error_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, system = _sides(spark, sf_dir)
    hit = matching.overlap_candidates(gold, system).select("doc_id", "annotator", "sys_id").distinct().withColumn("hit", F.lit(True))
    kinds = system.join(hit, ["doc_id", "annotator", "sys_id"], "left").withColumn("kind", F.when(F.col("hit"), "overlap").otherwise("spurious"))
    return _six(scoring.spurious_ratios(kinds, ["annotator"], "kind"))


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = tokens(spark, sf_dir).groupBy("doc_id", "sent_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "tok"))), lambda x: x["tok"]).alias("toks"))
    each = per.select("doc_id", "sent_idx", F.explode(sp.windows(F.col("toks"), 3)).alias("w"))
    return each.groupBy(F.array_join("w", " ").alias("window")).agg(F.count("*").alias("n")).filter("n > 1")


QUERIES = {f.__name__: f for f in (best_trigger_run, truncate_contentful, head_tokens, head_noun_tokens, root_tag_counts, tag_pairs, lists_read, filled_triggers, filled_with_all_parts, cut_triggers, noun_triggers, coref_closure_roles, coref_closure_members, label_score_ranks, spurious_error_ratios, sliding_windows)}

_TAGS = f"""with {TOKENS}, {SPANS}, tagged as (
  select doc_id, tok_idx, [{', '.join(repr(p) for p in POS)}][((doc_id * 3 + tok_idx::bigint * tok_idx) % 7 + 1)::integer] as pos,
    case when tok_idx % 4 = 0 then 'nsubj' when tok_idx % 5 = 0 then 'ROOT' else 'dep' end as dep, tok_idx + case when tok_idx % 3 = 0 then 1 else -1 end as head from tokens),
core as (select * from spans where annotator = 0),
parts as (select doc_id, span_id, first as f, last as l from spans where annotator = 1)"""
# The gap between core and part, in tokens that lie between them.
_GAP = "case when f > last then f - last - 1 when l < first then first - l - 1 else 0 end"
_FILLED = f"""filled as (select core.doc_id, core.span_id, case when {_GAP} <= 2 and f < first then f else first end as first, case when {_GAP} <= 2 and l > last then l else last end as last
  from core left join parts using (doc_id, span_id))"""


def _heads(base: str) -> str:
    """The root of each span of `base`: its first token whose head lies outside; roots(doc_id, span_id, first, last, root, found)."""
    return f"""each as (select b.doc_id, b.span_id, b.first, b.last, t.tok_idx, t.pos, t.dep, t.head from {base} b join tagged t on t.doc_id = b.doc_id and t.tok_idx >= b.first and t.tok_idx <= b.last),
roots as (select doc_id, span_id, any_value(first) as first, any_value(last) as last, min(tok_idx) filter (head < first or head > last or head = tok_idx) as found, coalesce(found, min(tok_idx)) as root from each group by 1, 2)"""


def _cut(base: str, width: int) -> str:
    """The window of most content of spans longer than width, the first of equal ones; spans without content stay."""
    gain = "case pos when 'NOUN' then 1.5 when 'ADJ' then 1 when 'VERB' then 1 when 'NUM' then 1 when 'PROPN' then 1 else 0 end + case when dep in ('nsubj', 'ROOT', 'amod', 'quantmod') then 0.5 else 0 end + case when tok_idx = found then 1 else 0 end"
    return f"""{_heads(base)},
gains as (select e.doc_id, e.span_id, e.first, e.last, e.tok_idx, e.pos, {gain} as gain from each e join roots r using (doc_id, span_id)),
sums as (select doc_id, span_id, first, last, tok_idx as start, pos as p0, sum(gain) over w as total, last_value(pos) over w as p1, count(*) over w as n from gains window w as (partition by doc_id, span_id order by tok_idx rows between current row and {width - 1} following)),
scores as (select *, total - case p0 when 'DET' then 0.5 when 'PUNCT' then 1.25 when 'ADP' then 1.25 when 'CCONJ' then 1.25 else 0 end - case when p1 in ('PUNCT', 'ADP', 'CCONJ') then 0.5 else 0 end as score from sums where n = {width}),
best as (select doc_id, span_id, arg_max(start, (score, -start)) as start from scores where last - first + 1 > {width} and score > 0 group by 1, 2)
select b.doc_id, b.span_id, coalesce(start, b.first)::integer as first, coalesce(start + {width - 1}, b.last)::integer as last from {base} b left join best using (doc_id, span_id)"""


def _noun(base: str) -> str:
    return f"""{_heads(base)},
nouns as (select r.doc_id, r.span_id, r.root, max(case when e.tok_idx = r.root then e.pos end) as root_pos, min(e.tok_idx) filter (e.head = r.root and e.tok_idx <> r.root and e.pos = 'NOUN') as child from roots r join each e using (doc_id, span_id) group by 1, 2, 3),
picked as (select doc_id, span_id, case when root_pos = 'NOUN' then root else coalesce(child, root) end as tok_idx from nouns)"""


_COREF = """with recursive p as (select distinct doc_uid, pronom_id, referent_id, text from canonrefs where pronom_id <> 0 and referent_id <> 0),
  s as (select doc_uid, pronom_id as a, referent_id as b from p where pronom_id <> referent_id union select doc_uid, referent_id, pronom_id from p where pronom_id <> referent_id),
  c(doc_uid, node, other) as (select doc_uid, a, a from s union select c.doc_uid, c.node, s.b from c join s on s.doc_uid = c.doc_uid and s.a = c.other),
  m as (select doc_uid, node, min(other) as component from c group by 1, 2)"""
ORACLES = {
    "best_trigger_run": f"""{_TAGS}, p as (select doc_id, (span_id // 20)::bigint as trigger, span_id, first, last from core),
      r as (select a.doc_id, a.trigger, a.span_id as i, b.span_id as j, a.first, b.last from p a join p b on a.doc_id = b.doc_id and a.trigger = b.trigger and a.span_id <= b.span_id where b.last - a.first < 16),
      c as (select distinct doc_id, trigger, unnest(range(first, last + 1))::integer as tok_idx from p),
      g as (select c.*, case when pos in ('ADJ', 'VERB', 'ADV', 'NUM', 'NOUN', 'ADP') then 1.0 when pos in ('AUX', 'PROPN') then 0.5 else 0 end::double as gain from c join tagged using (doc_id, tok_idx)),
      s as (select r.*, coalesce(sum(gain) filter (g.tok_idx >= r.first and g.tok_idx <= r.last), 0) as content from r left join g on g.doc_id = r.doc_id and g.trigger = r.trigger group by all),
      v as (select *, case when content > 0 then ln(content) / (1 + ln(last - first + 1)) else 0 end as value from s)
      select doc_id, trigger, i, j, first, last, round(value, 6) as value from (select *, row_number() over (partition by doc_id, trigger order by value desc, i, j) as k from v) where k = 1""",
    "head_tokens": f"{_TAGS}, {_heads('core')} select doc_id, span_id, root as tok_idx from roots",
    "head_noun_tokens": f"{_TAGS}, {_noun('core')} select doc_id, span_id, tok_idx from picked",
    "root_tag_counts": f"""{_TAGS}, {_heads('core')}, t as (select pos, dep from roots r join tagged t on t.doc_id = r.doc_id and t.tok_idx = r.found) select pos, dep, count(*) as n, round(count(*)::double / sum(count(*)) over (), 6) as share from t group by 1, 2""",
    "tag_pairs": f"{_TAGS} select pos || '_' || dep as tag, count(*) as n from tagged group by 1",
    "lists_read": "select p_partkey, case when p_size % 5 <> 0 then 2 else null end::integer as n, case when p_size % 5 <> 0 then p_type end as second from part",
    "filled_triggers": f"{_TAGS}, {_FILLED} select doc_id, span_id, first, last from filled",
    "filled_with_all_parts": f"{_TAGS} select core.doc_id, core.span_id, least(first, coalesce(f, first)) as first, greatest(last, coalesce(l, last)) as last from core left join parts using (doc_id, span_id)",
    "truncate_contentful": f"{_TAGS}, {_cut('core', 3)}",
    "cut_triggers": f"{_TAGS}, {_FILLED}, {_cut('filled', 4)}",
    "noun_triggers": f"{_TAGS}, {_FILLED}, {_noun('filled')} select doc_id, span_id, tok_idx as first, tok_idx as last from picked",
    "coref_closure_roles": f"""{_COREF} select t.doc_uid, coalesce(m.component, t.referent_id) as component, string_agg(distinct text, '|' order by text) as texts
      from p t left join m on m.doc_uid = t.doc_uid and m.node = t.referent_id where text is not null and t.doc_uid is not null group by 1, 2""",
    "coref_closure_members": f"{_COREF} select doc_uid, node, component from m",
    "label_score_ranks": f"""with {SPANS}, {_CAND}, d as (select doc_id, annotator, gold_id, max(dice) as d from matches group by all), b as (select x.annotator, g.label, d.d from (select distinct doc_id, annotator from matches) x join spans g on g.doc_id = x.doc_id and g.annotator = 0 left join d on d.doc_id = x.doc_id and d.annotator = x.annotator and d.gold_id = g.span_id),
      p as (select annotator, label, count(*) as n_gold, count(d) as n_matched, avg(coalesce(d, 0)) as mean_dice, count(d)::double / count(*) as share from b group by 1, 2)
      select annotator, label, n_gold, n_matched, round(mean_dice, 6) as mean_dice, round(share, 6) as share, (rank() over (partition by annotator order by share desc) + (count(*) over (partition by annotator, share) - 1) // 2)::integer as rank from p""",
    "spurious_error_ratios": f"with {SPANS}, {_CAND}, k as (select s.annotator, case when exists (select 1 from cand c where c.doc_id = s.doc_id and c.annotator = s.annotator and c.sys_id = s.span_id) then 'overlap' else 'spurious' end as kind from spans s where s.annotator > 0) select annotator, kind, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (partition by annotator), 6) as pct from k group by 1, 2",
    "sliding_windows": f"with {TOKENS}, w as (select tok || ' ' || lead(tok) over s || ' ' || lead(tok, 2) over s as w from tokens window s as (partition by doc_id, sent_idx order by tok_idx)) select w as window, count(*) as n from w where w is not null group by 1 having count(*) > 1",
}
