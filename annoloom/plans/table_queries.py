"""Agreement, lexical richness, statistics, relations, checks, duplicates and splits over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreement, dedupe, graph, lexical, quality, relations, stats
from ..operators import spans as sp
from ..operators.nested import flatten_records
from ..session import large
from ..sources.files import folded
from ..sources.tables import table
from .adapters import RATINGS, TOKENS, ratings, token_rows, tokens
from .problems import NESTED_SQL

CODERS = ["anno_01", "anno_02", "anno_03"]
STOP_WORDS = ["the", "a", "of", "and", "in", "to"]
GOLD_TYPES = ["ECONOMY ANODIZED STEEL"]


def _six(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# Agreement


def agreement_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(agreement.coefficients(ratings(spark, sf_dir)))


def cohen_kappa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = agreement.pairwise_agreement(agreement.complete_items(ratings(spark, sf_dir)))
    return _six(pairs.withColumn("kappa", F.try_divide(F.col("ao") - F.col("ae"), 1 - F.col("ae"))))


def krippendorff_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(agreement.krippendorff_alpha(ratings(spark, sf_dir)))


def percent_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(agreement.percent_agreement(ratings(spark, sf_dir)))


def pairwise_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(agreement.pairwise_prf(ratings(spark, sf_dir)))


def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.disagreements(ratings(spark, sf_dir)).select("item", F.array_join("labels", "|").alias("labels"))


def complete_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.complete_items(ratings(spark, sf_dir))


def rating_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.rating_matrix(ratings(spark, sf_dir), CODERS, "Missing")


# Lexical richness


def _by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts get their language before they are split: a document is one row there, not one a token.
    docs = table(spark, sf_dir, "documents")
    langs = docs.select("doc_id", F.lower(F.coalesce("lang", F.lit("und"))).alias("lang"))
    return token_rows(large(docs.select("doc_id", "text")).join(langs, "doc_id")).select("doc_id", "tok_idx", F.lower("tok").alias("tok"), "lang")


def lexical_richness_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(lexical.basic_richness(_by_lang(spark, sf_dir), ["lang"]))


def hdd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(lexical.hdd(_by_lang(spark, sf_dir), ["lang"]))


def msttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(lexical.msttr(tokens(spark, sf_dir).withColumn("tok", F.lower("tok")), ["doc_id"], ["tok_idx"]))


def mattr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(lexical.mattr(tokens(spark, sf_dir).withColumn("tok", F.lower("tok")), ["doc_id"], ["tok_idx"]))


def msttr_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(lexical.msttr(_by_lang(spark, sf_dir), ["lang"], ["doc_id", "tok_idx"]))


def mattr_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(lexical.mattr(_by_lang(spark, sf_dir), ["lang"], ["doc_id", "tok_idx"]))


def mtld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(lexical.mtld(tokens(spark, sf_dir).withColumn("tok", F.lower("tok")), ["doc_id"], ["tok_idx"]))


def mention_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(lexical.entropy(_elements(spark, sf_dir), ["layer"], "text"))


def lexical_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    basic = _six(lexical.basic_richness(_by_lang(spark, sf_dir), ["lang"])).select("lang", "ttr", "rttr", "maas")
    return lexical.ranked(basic, ["ttr", "rttr", "maas"])


def stop_words_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", lexical.without_stop_words(F.col("p_name"), STOP_WORDS).alias("name"))


# Relations of annotations


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.current(table(spark, sf_dir, "elements"), ["doc_uid", "element_id"], ["layer", "begin_pos", "end_pos", "text"])


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.current(table(spark, sf_dir, "links"), ["doc_uid", "link_id"], ["layer", "link_role", "event_id", "target_id"]).withColumnRenamed("layer", "link_layer")


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "canonrefs").select("doc_uid", "pronom_id", "referent_id")


def link_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.linked(_elements(spark, sf_dir).filter("layer in ('participant', 'filler')"), _links(spark, sf_dir)).select("doc_uid", "element_id", "layer", "link_id", "link_role", "event_id")


def first_link_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.first_link(_elements(spark, sf_dir).filter("layer = 'discontiguous'").select("doc_uid", "element_id", "text"), _links(spark, sf_dir))


def canonical_referents(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _elements(spark, sf_dir).filter("layer = 'participant'").select("doc_uid", "element_id")
    return relations.referents_of(people, _relations(spark, sf_dir)).select("doc_uid", "element_id", F.array_join(F.transform("referents", lambda x: x.cast("string")), " ").alias("referents"))


def link_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    lists = links.groupBy("doc_uid", "event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("link_id")), lambda x: x.cast("string")), " ").alias("ids"))
    return relations.by_id_list(lists, "ids", links.select("doc_uid", "link_id", "target_id", "link_layer"), ["doc_uid"], "link_id").select("doc_uid", "event_id", "link_id", "target_id", "link_layer")


def canonical_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = _elements(spark, sf_dir).filter("layer = 'participant'")
    return relations.replace_by_referents(elements.select("doc_uid", "element_id", "begin_pos", "end_pos"), _relations(spark, sf_dir), elements)


def coref_symmetric_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _relations(spark, sf_dir).filter("pronom_id <> 0 and referent_id <> 0")
    return graph.symmetric(pairs, ["doc_uid"], "pronom_id", "referent_id")


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of a document that links tie together, through their events."""
    return graph.star_components(_links(spark, sf_dir), "event_id", "target_id", ["doc_uid"]).withColumnRenamed("group", "component")


def coordination_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.coordination_groups(_elements(spark, sf_dir))


def interval_union_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = sp.interval_union(_elements(spark, sf_dir), ["doc_uid"], "begin_pos", "end_pos", order=("element_id",))
    return grouped.groupBy("doc_uid", "group_no").agg(F.count("*").alias("n"), F.min("begin_pos").alias("begin_pos"), F.max("end_pos").alias("end_pos"))


def touching_union_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = sp.interval_union(_elements(spark, sf_dir), ["doc_uid"], "begin_pos", "end_pos", touching=True, order=("element_id",))
    return grouped.groupBy("doc_uid").agg(F.max("group_no").alias("n_groups"))


def span_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = _elements(spark, sf_dir)
    inner = elements.filter("layer <> 'event'").withColumnRenamed("element_id", "inner_id")
    return relations.contained(inner, elements.filter("layer = 'event'").withColumnRenamed("element_id", "outer_id"), ["doc_uid"])


# Checks


def weak_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    events = _elements(spark, sf_dir).filter("layer = 'event'").select("doc_uid", "element_id", "text")
    return quality.weakly_realized(events, *(links.filter(F.col("link_layer") == k) for k in ("participant", "filler")))


def role_typology_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    typology = table(spark, sf_dir, "typology")
    roles = [typology.select(F.lit(k).alias("layer"), F.explode(k).alias("r")) for k in ("participant", "filler")]
    named = roles[0].unionByName(roles[1]).select("layer", quality.role_stem(F.col("r.name")).alias("stem"))
    links = _links(spark, sf_dir).withColumnRenamed("link_layer", "layer").filter("layer <> 'discontiguous'")
    return quality.role_violations(links, named, ["when"]).select("doc_uid", "link_id", "layer", "link_role")


def typed_role_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_annotations")
    return quality.typed_role_violations(flatten_records(raw, "children"), flatten_records(raw, "events"), table(spark, sf_dir, "typology"))


def unit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = _elements(spark, sf_dir)
    linked = _links(spark, sf_dir).select("doc_uid", F.col("target_id").alias("element_id")).distinct()
    one = elements.filter("text is null or trim(text) = ''").select("doc_uid", "element_id", F.lit("no text").alias("issue"))
    two = elements.filter("end_pos - begin_pos > 20").select("doc_uid", "element_id", F.lit("long").alias("issue"))
    three = elements.filter("layer in ('participant', 'filler')").join(linked, ["doc_uid", "element_id"], "left_anti").select("doc_uid", "element_id", F.lit("no link").alias("issue"))
    return quality.issue_list(one.unionByName(two).unionByName(three), ["doc_uid", "element_id"]).select("doc_uid", "element_id", F.array_join("issues", "|").alias("issues"), "n_issues")


def issue_counts_by_annotator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "elements")
    return rows.groupBy("annotator_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("deleted_at").isNotNull()).alias("n_deleted"), F.count_if(F.col("document_title").isNull()).alias("n_untitled"), F.count_if(F.col("end_pos") - F.col("begin_pos") > 20).alias("n_long"), F.count_if(F.col("layer") == "event").alias("n_events")
    )


# Statistics


def type_subtype_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.type_rollup(table(spark, sf_dir, "documents"), "lang", "source")


def value_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(stats.shares(table(spark, sf_dir, "events"), ["event_type"]))


def share_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "dev").otherwise("train"))
    return _six(stats.shares(docs, ["split", "source"], ["split"], keep_null=False))


def role_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(stats.role_ratios(_links(spark, sf_dir), "link_layer", "link_role"))


def company_lookup_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower(stats.company_letters(F.trim("title"))).alias("company"))
    return docs.groupBy(F.coalesce("company", F.lit("Unresolved")).alias("company")).agg(F.count("*").alias("n"))


def industry_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    shares = stats.shares(n, ["r_name", "c_mktsegment"], ["r_name"])
    return shares.select(F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"), "n", F.round("share", 6).alias("share"), F.round(F.col("share") - 0.2, 6).alias("delta"))


def median_like_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.median_like(table(spark, sf_dir, "documents").filter("lang is not null"), ["lang"], "n_chars", "doc_id")


def doc_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokens(spark, sf_dir).groupBy("doc_id").agg(F.count("*").cast("double").alias("n_tokens"), (F.max("sent_idx") + 1).cast("double").alias("n_sentences"))
    return _six(stats.regressions(docs.withColumn("every", F.lit("all")), ["every"], "n_sentences", "n_tokens"))


def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "documents"), "n_chars", 0.0, 5000.0, 20)


def segment_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").cast("double").alias("n"), F.avg("c_acctbal").alias("balance"))
    return _six(stats.z_scores(per, ["n", "balance"])).select("c_mktsegment", "z_n", "z_balance")


def n_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tuples(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_partkey", 2).select("l_orderkey", "tuple_no", F.array_join(F.transform("members", lambda x: x.cast("string")), " ").alias("members"))


def dict_zip_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return stats.full_outer({k: events.filter(F.col("event_type") == k) for k in ("click", "error", "purchase", "signup", "view")}, "user_id", "n")


def unit_union_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    fillers = table(spark, sf_dir, "fillers").select("doc_uid", "element_id", "text", F.col("filler_role").alias("role"))
    triggers = table(spark, sf_dir, "discont_triggers").select("doc_uid", "element_id", "text")
    union = fillers.unionByName(triggers, allowMissingColumns=True).withColumn("role", F.coalesce("role", F.lit("trigger")))
    return union.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"))


# Duplicates, differences, splits, fingerprints


def dedupe_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.md5("text").alias("text_md5"))
    return dedupe.keep_best(docs, ["text_md5"], [F.desc("n_chars"), F.when(F.col("source") == "newswire", 1).otherwise(0), F.asc("doc_id")])


def drop_duplicates_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("source is not null").withColumn("text_md5", F.md5("text"))
    return dedupe.drop_duplicates_first(docs, ["source", "text_md5"], "doc_id", ["n_chars"])


def set_diff_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "documents").select(dedupe.title_key(F.trim("title")).alias("title_key"))
    marked = table(spark, sf_dir, "elements").select(dedupe.title_key(F.trim("document_title")).alias("title_key"))
    return dedupe.difference(titles.filter("title_key is not null"), marked.filter("title_key is not null"), "title_key")


def repeated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose headline, the title after its first "_", starts with the same 16 letters and digits as another one's."""
    headline = dedupe.title_key(F.regexp_replace("title", "^[^_]*_", ""), most=16)
    return dedupe.repeated(table(spark, sf_dir, "documents").select("doc_id", headline.alias("title_key")).filter("title_key is not null"), ["title_key"])


def dev_one_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.one_per_group(table(spark, sf_dir, "documents").select("doc_id", "ticker"), "ticker", "doc_id")


def fixed_id_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.fixed_split(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", {"train": list(range(15)), "dev": [15, 16, 17], "test": [18, 19, 20]})


def gold_or_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    return dedupe.gold_or_silver(parts, "p_type", "p_brand", GOLD_TYPES, "Brand#11").groupBy("split").agg(F.count("*").alias("n"))


def dir_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One md5 over the ordered md5s of all columns of a table's rows, folded by ranges of 4096 keys, of 4096 such ranges and so on: no task holds more."""
    orders = table(spark, sf_dir, "orders")
    folds = orders.select(F.col("o_orderkey").alias("k"), F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")), F.date_format("o_orderdate", "yyyy-MM-dd"), F.round(F.col("o_totalprice") * 100).cast("long").cast("string"))).alias("h"))
    for _ in range(6):  # 2^72 keys
        folds = folds.groupBy(F.floor(F.col("k") / 4096).alias("k2")).agg(folded("k", "h").alias("h")).select(F.col("k2").alias("k"), "h")
    return folds.select(F.col("h").alias("fingerprint"))


QUERIES = {
    f.__name__: f
    for f in (
        agreement_coefficients, cohen_kappa_pairs, krippendorff_alpha, percent_agreement, pairwise_prf, disagreements, complete_items, rating_matrix,
        lexical_richness_basic, hdd, msttr, mattr, msttr_by_lang, mattr_by_lang, mtld, mention_entropy, lexical_ranks, stop_words_removed,
        link_join, first_link_join, canonical_referents, link_list_join, canonical_replacement, coref_symmetric_edges, connected_components, coordination_groups, interval_union_groups, touching_union_groups, span_containment,
        weak_events, role_typology_violations, typed_role_violations, unit_issues, issue_counts_by_annotator,
        type_subtype_rollup, value_shares, share_by_split, role_ratios, company_lookup_unresolved, industry_delta, median_like_pick, doc_regression, value_histogram, segment_z_scores, n_tuples, dict_zip_full_outer, unit_union_coalesce,
        dedupe_keep_best, drop_duplicates_first, set_diff_both, repeated_titles, dev_one_per_group, fixed_id_split, gold_or_silver, dir_fingerprint,
    )
}

_R = f"with {RATINGS}, pairs as (select x.coder as a, y.coder as b, item, x.label as la, y.label as lb from complete x join complete y using (item) where x.coder < y.coder)"
_AGREE = """po as (select a, b, count(*) as n, sum((la = lb)::int)::double / count(*) as ao from pairs group by 1, 2),
pe as (select a, b, sum(na * nb)::double as products from (select a, b, la as label, count(*) as na from pairs group by all) join (select a, b, lb as label, count(*) as nb from pairs group by all) using (a, b, label) group by 1, 2),
pw as (select po.a, po.b, ao, coalesce(products, 0) / (n * n) as ae from po left join pe using (a, b))"""
_L = f"with {TOKENS}, lt as (select doc_id, tok_idx, lower(tok) as tok, lower(coalesce(lang, 'und')) as lang from tokens join documents using (doc_id))"
_BASIC = "basic as (select lang, sum(n)::bigint as w, count(*) as t from (select lang, tok, count(*) as n from lt group by 1, 2) group by 1)"
_X = """with el as (select * exclude (rn) from (select doc_uid, element_id, layer, begin_pos, end_pos, text, deleted_at, row_number() over (partition by doc_uid, element_id order by ingested_at desc nulls last, deleted_at is not null desc, layer desc nulls last, begin_pos desc nulls last, end_pos desc nulls last, text desc nulls last) as rn from elements) where rn = 1 and deleted_at is null),
lk as (select doc_uid, link_id, layer as link_layer, link_role, event_id, target_id from (select *, row_number() over (partition by doc_uid, link_id order by ingested_at desc nulls last, deleted_at is not null desc, layer desc nulls last, link_role desc nulls last, event_id desc nulls last, target_id desc nulls last) as rn from links) where rn = 1 and deleted_at is null),
rel as (select distinct doc_uid, pronom_id, referent_id from canonrefs where pronom_id <> 0 and referent_id <> 0)"""


def _union_sql(compare: str) -> str:
    return f"""{_X}, f as (select *, max(end_pos) over (partition by doc_uid order by begin_pos, end_pos, element_id rows between unbounded preceding and 1 preceding) as reach from el),
n as (select *, sum(case when reach is null or begin_pos {compare} reach then 1 else 0 end) over (partition by doc_uid order by begin_pos, end_pos, element_id rows between unbounded preceding and current row)::bigint as group_no from f)"""


def _rank_sql(c: str, asc: bool = False) -> str:
    return f"(rank() over (order by {c} {'asc' if asc else 'desc'}) + (count(*) over (partition by {c}) - 1) // 2)::integer"


_TITLE = "regexp_replace(lower(trim({})), '[^a-z0-9]', '', 'g')"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLES = {
    "agreement_coefficients": f"""{_R}, {_AGREE}, m as (select sum(n * n)::double as sq, sum(n)::double as cells, count(*) as k from (select label, count(*) as n from complete group by 1)), i as (select count(distinct item) as n_items from complete), p as (select avg(ao) as ao, avg(ae) as ae, avg((ao - ae) / (1 - ae)) as kappa from pw)
      select n_items, round(ao, 6) as mean_ao, round(kappa, 6) as kappa, round(kappa, 6) as weighted_kappa, round((ao - ae) / (1 - ae), 6) as multi_kappa, round((ao - sq / (cells * cells)) / (1 - sq / (cells * cells)), 6) as multi_pi, round((ao - 1.0::double / k) / (1 - 1.0::double / k), 6) as s from p, m, i""",
    "cohen_kappa_pairs": f"{_R}, {_AGREE} select a, b, round(ao, 6) as ao, round(ae, 6) as ae, round((ao - ae) / (1 - ae), 6) as kappa from pw",
    "krippendorff_alpha": f"""with {RATINGS}, t as (select item, label, count(*) as n from votes group by 1, 2), p as (select * from (select *, sum(n) over (partition by item) as m from t) where m > 1),
      o as (select sum(n * (m - n)::double / (m - 1)) as d, sum(n)::double as v, count(distinct item) as n_items from p), e as (select sum(n * n)::double as sq from (select label, sum(n) as n from p group by 1))
      select n_items, v::bigint as n_values, round(1 - (d / v) / ((v * v - sq) / (v * (v - 1))), 6) as alpha from o, e""",
    "percent_agreement": f"{_R}, s as (select item, avg((la = lb)::int::double) as share from pairs group by 1) select count(*) as n_items, round(avg(share), 6) as mean_share, round(avg((share = 1)::int::double), 6) as strict_share from s",
    "pairwise_prf": f"""{_R}, l as (select a, b, la as label, count(*) as na from pairs group by all), r as (select a, b, lb as label, count(*) as nb from pairs group by all), h as (select a, b, la as label, count(*) as tp from pairs where la = lb group by all),
      x as (select a, b, label, coalesce(na, 0) as na, coalesce(nb, 0) as nb, coalesce(tp, 0)::double as tp from l full join r using (a, b, label) left join h using (a, b, label))
      select a, b, label, round(coalesce(tp / nullif(nb, 0), 0), 6) as precision, round(coalesce(tp / nullif(na, 0), 0), 6) as recall, round(2 * tp / (na + nb), 6) as f1 from x
      union all select a, b, null, round(sum(tp) / sum(na), 6), round(sum(tp) / sum(na), 6), round(sum(tp) / sum(na), 6) from x group by 1, 2""",
    "disagreements": f"with {RATINGS} select item, string_agg(label, '|' order by label) as labels from (select distinct item, label from votes) group by 1 having count(*) > 1",
    "complete_items": f"with {RATINGS} select item, coder, label from complete",
    "rating_matrix": f"with {RATINGS} select item, " + ", ".join(f"coalesce(max(label) filter (coder = '{c}'), 'Missing') as {c}" for c in CODERS) + " from votes group by 1",
    "lexical_richness_basic": f"{_L}, {_BASIC} select lang, w, t, round(t::double / w, 6) as ttr, round(t / sqrt(w), 6) as rttr, round(t / sqrt(2 * w), 6) as cttr, round(case when t > 0 and w > 1 then ln(t) / ln(w) end, 6) as herdan, round(case when t > 1 and w > 1 and ln(ln(w)) <> 0 then ln(ln(t)) / ln(ln(w)) end, 6) as summer, round(case when w > t then ln(w) ^ 2 / (ln(w) - ln(t)) end, 6) as dugast, round(case when w > 1 then (ln(w) - ln(t)) / ln(w) ^ 2 end, 6) as maas from basic",
    "hdd": f"{_L}, f as (select lang, n, count(*) as types from (select lang, tok, count(*) as n from lt group by 1, 2) group by 1, 2), w as (select lang, sum(n * types)::double as w from f group by 1 having sum(n * types) >= 42), c as (select lang, n, types, w, product(greatest(0, w - n - i) / (w - i)) as absent from f join w using (lang), range(42) r(i) group by 1, 2, 3, 4) select lang, round(sum(types * (1 - absent)) / 42, 6) as hdd from c group by 1",
    "msttr": f"{_L}, s as (select doc_id, tok_idx // 25 as s, count(*) as n, count(distinct tok) as t from lt group by 1, 2) select doc_id, round(avg(t::double / 25), 6) as msttr from s where n = 25 group by 1",
    "mattr": f"{_L}, p as (select doc_id, tok, tok_idx + 1 as p, coalesce(lag(tok_idx + 1) over (partition by doc_id, tok order by tok_idx), 0) as prev, count(*) over (partition by doc_id) as w from lt) select doc_id, round(sum(greatest(0, least(p, w - 24) - greatest(prev + 1, p - 24, 1) + 1))::double / ((max(w) - 24) * 25), 6) as mattr from p where w >= 25 group by 1",
    "msttr_by_lang": f"{_L}, p as (select lang, tok, row_number() over (partition by lang order by doc_id, tok_idx) - 1 as p from lt), s as (select lang, p // 25 as s, count(*) as n, count(distinct tok) as t from p group by 1, 2) select lang, round(avg(t::double / 25), 6) as msttr from s where n = 25 group by 1",
    "mattr_by_lang": f"{_L}, o as (select lang, tok, row_number() over (partition by lang order by doc_id, tok_idx) as p, count(*) over (partition by lang) as w from lt), p as (select *, coalesce(lag(p) over (partition by lang, tok order by p), 0) as prev from o) select lang, round(sum(greatest(0, least(p, w - 24) - greatest(prev + 1, p - 24, 1) + 1))::double / ((max(w) - 24) * 25), 6) as mattr from p where w >= 25 group by 1",
    "mention_entropy": f"{_X}, c as (select layer, text, count(*) as n from el where text is not null group by 1, 2) select layer, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as entropy from c group by 1",
    "lexical_ranks": f"{_L}, {_BASIC}, b as (select lang, round(t::double / w, 6) as ttr, round(t / sqrt(w), 6) as rttr, round(case when w > 1 then (ln(w) - ln(t)) / ln(w) ^ 2 end, 6) as maas from basic), r as (select *, {_rank_sql('ttr')} as rank_ttr, {_rank_sql('rttr')} as rank_rttr, {_rank_sql('maas', True)} as rank_maas from b), q as (select *, rank_ttr + rank_rttr + rank_maas as rank_sum from r) select *, {_rank_sql('rank_sum', True)} as rank_all from q",
    "stop_words_removed": f"select p_partkey, array_to_string(list_filter(regexp_split_to_array(trim(p_name), '\\s+'), lambda w: not list_contains([{_STOPS}], lower(w))), ' ') as name from part",
    "link_join": f"{_X} select doc_uid, element_id, layer, link_id, link_role, event_id from el join lk on lk.doc_uid = el.doc_uid and lk.target_id = el.element_id where layer in ('participant', 'filler')".replace("select doc_uid, element_id, layer, link_id", "select el.doc_uid, element_id, layer, link_id"),
    "first_link_join": f"{_X} select el.doc_uid, element_id, text, min(link_id) as link_id from el left join lk on lk.doc_uid = el.doc_uid and lk.target_id = el.element_id where layer = 'discontiguous' group by 1, 2, 3",
    "canonical_referents": f"{_X} select el.doc_uid, element_id, string_agg(referent_id::varchar, ' ' order by referent_id) as referents from el left join rel on rel.doc_uid = el.doc_uid and pronom_id = element_id where layer = 'participant' group by 1, 2",
    "link_list_join": f"{_X} select doc_uid, event_id, link_id, target_id, link_layer from lk where doc_uid is not null",
    "canonical_replacement": f"{_X}, p as (select * from el where layer = 'participant') select p.doc_uid, p.element_id, coalesce(referent_id, p.element_id) as new_id, coalesce(q.begin_pos, p.begin_pos) as begin_pos, coalesce(q.end_pos, p.end_pos) as end_pos from p left join rel on rel.doc_uid = p.doc_uid and pronom_id = p.element_id left join p q on q.doc_uid = p.doc_uid and q.element_id = referent_id where referent_id is null or q.begin_pos is not null",
    "coref_symmetric_edges": f"{_X} select doc_uid, pronom_id as src, referent_id as dst from rel where pronom_id <> referent_id union select doc_uid, referent_id, pronom_id from rel where pronom_id <> referent_id",
    "connected_components": f"with recursive {_X[5:]}, s as (select doc_uid, event_id as a, target_id as b from lk where event_id <> target_id union select doc_uid, target_id, event_id from lk where event_id <> target_id), c(doc_uid, node, other) as (select doc_uid, a, a from s union select c.doc_uid, c.node, s.b from c join s on s.doc_uid = c.doc_uid and s.a = c.other) select doc_uid, node, min(other) as component from c group by 1, 2",
    "coordination_groups": f"{_X}, g as (select doc_uid, element_id, begin_pos, end_pos, count(*) over (partition by doc_uid, begin_pos, end_pos) as n from el where begin_pos is not null and end_pos is not null) select doc_uid, element_id, dense_rank() over (partition by doc_uid order by begin_pos, end_pos)::integer as coord_group from g where n > 1",
    "interval_union_groups": _union_sql(">=") + " select doc_uid, group_no, count(*) as n, min(begin_pos) as begin_pos, max(end_pos) as end_pos from n group by 1, 2",
    "touching_union_groups": _union_sql(">") + " select doc_uid, max(group_no) as n_groups from n group by 1",
    "span_containment": f"{_X} select i.doc_uid, i.element_id as inner_id, i.begin_pos, i.end_pos, o.element_id as outer_id, o.begin_pos as outer_begin, o.end_pos as outer_end from el i join el o on i.doc_uid = o.doc_uid and o.begin_pos <= i.begin_pos and i.end_pos <= o.end_pos where i.layer <> 'event' and o.layer = 'event' and i.begin_pos <= i.end_pos and o.begin_pos <= o.end_pos",
    "weak_events": f"{_X} select doc_uid, element_id, text from el where layer = 'event' and not exists (select 1 from lk where lk.doc_uid = el.doc_uid and lk.event_id = el.element_id and link_layer in ('participant', 'filler'))",
    "role_typology_violations": f"{_X}, roles as (select 'participant' as layer, unnest(participant).name as name from typology union select 'filler', unnest(filler).name from typology), stems as (select distinct layer, lower(trim(split_part(name, '_', 1))) as stem from roles), n as (select *, nullif(trim(lower(split_part(link_role, '_', 1))), '') as stem from lk where link_layer <> 'discontiguous') select doc_uid, link_id, link_layer as layer, link_role from n where coalesce(stem, '') <> 'when' and not exists (select 1 from stems s where s.layer = n.link_layer and s.stem = n.stem)",
    "unit_issues": f"""{_X}, i as (select doc_uid, element_id, 'no text' as issue from el where text is null or trim(text) = '' union all select doc_uid, element_id, 'long' from el where end_pos - begin_pos > 20
      union all select doc_uid, element_id, 'no link' from el where layer in ('participant', 'filler') and not exists (select 1 from lk where lk.doc_uid = el.doc_uid and lk.target_id = el.element_id)) select doc_uid, element_id, string_agg(issue, '|' order by issue) as issues, count(*) as n_issues from i group by 1, 2""",
    "issue_counts_by_annotator": "select annotator_id, count(*) as n, count(*) filter (deleted_at is not null) as n_deleted, count(*) filter (document_title is null) as n_untitled, count(*) filter (end_pos - begin_pos > 20) as n_long, count(*) filter (layer = 'event') as n_events from elements group by 1",
    "type_subtype_rollup": "with d as (select lang, coalesce(source, 'unspecified') as source from documents) select lang, source, count(*) as n from d group by 1, 2 union all select lang, null, count(*) from d group by 1 having count(distinct source) > 1",
    "value_shares": "select event_type, count(*) as n, round(count(*)::double / sum(count(*)) over (), 6) as share from events group by 1",
    "share_by_split": "with d as (select case when doc_id % 10 = 0 then 'test' when doc_id % 10 = 1 then 'dev' else 'train' end as split, source from documents where source is not null) select split, source, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by split), 6) as share from d group by 1, 2",
    "role_ratios": f"{_X} select link_layer, link_role, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by link_layer), 6) as n_over_type_participants from lk where link_role is not null and link_layer is not null group by 1, 2",
    "company_lookup_unresolved": "select coalesce(case when not regexp_matches(trim(title), '^[0-9]') then lower(regexp_replace(split_part(trim(title), '_', 1), '[0-9]', '', 'g')) end, 'Unresolved') as company, count(*) as n from documents group by 1",
    "industry_delta": "with s as (select r_name as region, c_mktsegment as segment, count(*) as n, count(*)::double / sum(count(*)) over (partition by r_name) as share from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2) select region, segment, n, round(share, 6) as share, round(share - 0.2::double, 6) as delta from s",
    "median_like_pick": "select lang, doc_id, n_chars from (select d.lang, doc_id, n_chars, row_number() over (partition by d.lang order by abs(n_chars - m), doc_id) as rn from documents d join (select lang, avg(n_chars) as m from documents group by 1) using (lang)) where rn = 1",
    "doc_regression": f"with {TOKENS}, d as (select doc_id, count(*)::double as x, (max(sent_idx) + 1)::double as y from tokens group by 1) select 'all' as every, count(*) as n, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, round(regr_r2(y, x), 6) as r2, round(regr_slope(y, ln(x)), 6) as log_slope, round(regr_intercept(y, ln(x)), 6) as log_intercept, round(regr_r2(y, ln(x)), 6) as log_r2 from d",
    "value_histogram": "select case when n_chars < 0 then 0 when n_chars >= 5000 then 21 else n_chars // 250 + 1 end::bigint as bin, count(*) as n from documents where n_chars is not null group by 1",
    "segment_z_scores": "with p as (select c_mktsegment, count(*)::double as n, avg(c_acctbal) as b from customer group by 1) select c_mktsegment, round((n - avg(n) over ()) / nullif(stddev_samp(n) over (), 0), 6) as z_n, round((b - avg(b) over ()) / nullif(stddev_samp(b) over (), 0), 6) as z_balance from p",
    "n_tuples": "with p as (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as p from lineitem) select l_orderkey, (p // 2)::bigint as tuple_no, string_agg(l_partkey::varchar, ' ' order by p) as members from p group by 1, 2 having count(*) = 2",
    "dict_zip_full_outer": "select user_id, count(*) filter (event_type = 'click') as \"click\", count(*) filter (event_type = 'error') as \"error\", count(*) filter (event_type = 'purchase') as \"purchase\", count(*) filter (event_type = 'signup') as \"signup\", count(*) filter (event_type = 'view') as \"view\" from events where event_type in ('click', 'error', 'purchase', 'signup', 'view') group by 1",
    "unit_union_coalesce": "select coalesce(role, 'trigger') as role, count(*) as n, count(distinct text) as n_texts from (select filler_role as role, text from fillers union all select null, text from discont_triggers) group by 1",
    "dedupe_keep_best": "select doc_id, source, n_chars, text_md5 from (select doc_id, source, n_chars, md5(text) as text_md5, row_number() over (partition by md5(text) order by n_chars desc, case when source = 'newswire' then 1 else 0 end, doc_id) as rn from documents) where rn = 1",
    "drop_duplicates_first": "select source, md5(text) as text_md5, min(doc_id) as doc_id, arg_min(n_chars, doc_id) as n_chars from documents where source is not null group by 1, 2",
    "set_diff_both": f"with a as (select distinct {_TITLE.format('title')} as title_key from documents where title is not null), b as (select distinct {_TITLE.format('document_title')} as title_key from elements where document_title is not null) select title_key, 'left' as side from (select * from a except select * from b) union all select title_key, 'right' from (select * from b except select * from a)",
    "typed_role_violations": NESTED_SQL + """, ty as (select maintype_name as m, subtype_name as s, 'participant' as layer, unnest(participant, recursive := true) from typology union all select maintype_name, subtype_name, 'filler', unnest(filler, recursive := true) from typology),
      k as (select c.rid as record_id, c.doc_uid, c.event_no, c.layer, c.link_id, c.role, et.txt as m, es.txt as s, nullif(trim(lower(split_part(c.role, '_', 1))), '') as stem from children c left join f et on et.rid = c.rid and et.nid = c.event and et.k = 'type' left join f es on es.rid = c.rid and es.nid = c.event and es.k = 'subtype' where c.layer in ('participant', 'filler'))
      select record_id, doc_uid, event_no, layer, link_id, role, case when s is null then 'not on type' else 'not on subtype' end as problem from k where
        (s is null and not exists (select 1 from ty where ty.m = k.m and ty.layer = k.layer and ty.on_type and nullif(trim(lower(split_part(name, '_', 1))), '') = k.stem))
        or (s is not null and not exists (select 1 from ty where ty.m = k.m and ty.s = k.s and ty.layer = k.layer and ty.on_subtype and nullif(trim(lower(split_part(name, '_', 1))), '') = k.stem))""",
    "mtld": f"""with {TOKENS}, w as (select doc_id, list(lower(tok) order by tok_idx) as ws, count(*) as n from tokens group by 1),
      d as (select doc_id, n, ws from w union all select doc_id, n, list_reverse(ws) from w),
      r as (select doc_id, n, list_reduce(list_concat([{{'t': '', 'seen': []::varchar[], 'n': 0::bigint, 'f': 0::double}}], list_transform(ws, lambda t: {{'t': t, 'seen': []::varchar[], 'n': 0::bigint, 'f': 0::double}})),
        lambda acc, x: case when len(list_distinct(list_append(acc.seen, x.t)))::double / (acc.n + 1) <= 0.72 then {{'t': '', 'seen': []::varchar[], 'n': 0::bigint, 'f': acc.f + 1}} else {{'t': '', 'seen': list_distinct(list_append(acc.seen, x.t)), 'n': acc.n + 1, 'f': acc.f}} end) as x from d),
      g as (select doc_id, n, x.f + case when x.n > 0 then (1 - len(x.seen)::double / x.n) / (1 - 0.72) else 0 end as f from r)
      select doc_id, round(case when min(f) > 0 then avg(n / f) end, 6) as mtld from g group by 1""",
    "repeated_titles": "with t as (select doc_id, left(regexp_replace(lower(regexp_replace(title, '^[^_]*_', '')), '[^a-z0-9]', '', 'g'), 16) as title_key from documents where title is not null) select * from (select *, count(*) over (partition by title_key) as n from t) where n > 1",
    "dev_one_per_group": "select doc_id, ticker, case when row_number() over (partition by ticker order by md5(doc_id::varchar), doc_id) = 1 then 'dev' else 'train' end as split from documents",
    "fixed_id_split": "select n_nationkey, n_name, case when n_nationkey < 15 then 'train' when n_nationkey < 18 then 'dev' else 'test' end as split from nation where n_nationkey <= 20",
    "gold_or_silver": "select split, count(*) as n from (select case when p_type in ('ECONOMY ANODIZED STEEL') then case when p_brand = 'Brand#11' then 'test' end else 'dev' end as split from part) where split is not null group by 1",
    "dir_fingerprint": "with f0 as (select o_orderkey as k, md5(concat_ws('|', o_orderkey::varchar, o_custkey::varchar, o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d'), round(o_totalprice * 100)::bigint::varchar)) as h from orders), f1 as (select k // 4096 as k, md5(string_agg(h, '' order by k, h)) as h from f0 group by 1), f2 as (select k // 4096 as k, md5(string_agg(h, '' order by k, h)) as h from f1 group by 1), f3 as (select k // 4096 as k, md5(string_agg(h, '' order by k, h)) as h from f2 group by 1), f4 as (select k // 4096 as k, md5(string_agg(h, '' order by k, h)) as h from f3 group by 1), f5 as (select k // 4096 as k, md5(string_agg(h, '' order by k, h)) as h from f4 group by 1), f6 as (select k // 4096 as k, md5(string_agg(h, '' order by k, h)) as h from f5 group by 1) select h as fingerprint from f6",
}
