"""Views of the tables as tokens, spans and ratings: what the reference-style operators take. Each has the same rule as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import large, spread
from ..sources.tables import table

LABELS = ("positive", "neutral", "negative")


def token_rows(texts: DataFrame) -> DataFrame:
    """(doc_id, tok_idx, tok, sent_idx, further columns of texts): tokens between blanks and line ends; a sentence ends with a token that ends in '.'."""
    # Split at blanks after a full stop, then at blanks: numbered inside the text's own row, so that nothing is shuffled.
    words = F.transform(F.split("text", r"(?<=\.)[ \n]+"), lambda s: F.filter(F.split(s, "[ \n]+"), lambda x: x != ""))
    more = [c for c in texts.columns if c not in ("doc_id", "text")]
    docs = texts.select("doc_id", *more, words.alias("words"))
    numbers = F.flatten(F.transform("words", lambda x, i: F.array_repeat(i, F.size(x))))
    each = docs.select("doc_id", *more, F.posexplode(F.arrays_zip(F.flatten("words").alias("tok"), numbers.alias("sent_idx"))).alias("tok_idx", "x"))
    return large(each.select("doc_id", "tok_idx", F.col("x.tok").alias("tok"), F.col("x.sent_idx").alias("sent_idx"), *more))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tok_idx, tok, sent_idx) of the documents' texts."""
    return token_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, annotator, span_id, first, last, label): annotator 0 is the gold one, 1 and 2 are systems; a span is named by its anchor token."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.size(F.filter(F.split("text", "[ \n]+"), lambda x: x != "")).alias("n")).filter("n > 0")
    anchors = docs.select("doc_id", "n", F.explode(F.expr("sequence(0, n - 1)")).alias("t")).filter("(doc_id * 7 + t * 13) % 5 = 0")
    each = anchors.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("annotator")).filter("(t + annotator * 3 + doc_id) % 5 <> 0")
    start = "t + (annotator * t) % 2"
    label = F.element_at(F.array(*(F.lit(x) for x in LABELS)), F.expr("cast((t + case when (t + annotator) % 7 = 0 then 1 else 0 end) % 3 as int)") + 1)
    return large(each.select("doc_id", "annotator", F.col("t").alias("span_id"), F.expr(f"least({start}, n - 1)").alias("first"), F.expr(f"least({start} + (t * 3 + annotator * 2) % 9, n - 1)").alias("last"), label.alias("label")))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(coder, item, label) of the latest delivery of each item; cells that say there is no label are null."""
    coders = ("anno_01", "anno_02", "anno_03")
    rows = table(spark, sf_dir, "events_event_type").select("item_id", F.struct("exported_at", *coders).alias("x"))
    last = rows.groupBy("item_id").agg(F.max("x").alias("x"))
    cell = lambda c: F.when(~F.lower(F.trim(F.col("x")[c])).isin("", "-", "na", "missing"), F.lower(F.trim(F.col("x")[c])))
    return last.select(F.col("item_id").alias("item"), F.explode(F.array(*(F.struct(F.lit(c).alias("coder"), cell(c).alias("label")) for c in coders))).alias("r")).select("r.coder", "item", "r.label")


TOKENS = """tokens as (
  select doc_id, tok_idx, tok, cast(coalesce(sum(case when suffix(tok, '.') then 1 else 0 end) over (partition by doc_id order by tok_idx rows between unbounded preceding and 1 preceding), 0) as integer) as sent_idx
  from (select doc_id, unnest(range(len(a)))::integer as tok_idx, unnest(a) as tok from (select doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') as a from documents)))"""

SPANS = """span_docs as (select doc_id, len(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> ''))::bigint as n from documents),
spans as (
  select doc_id, annotator, t::integer as span_id, least(t + (annotator * t) % 2, n - 1)::integer as first, least(t + (annotator * t) % 2 + (t * 3 + annotator * 2) % 9, n - 1)::integer as last,
    ['positive', 'neutral', 'negative'][((t + case when (t + annotator) % 7 = 0 then 1 else 0 end) % 3 + 1)::integer] as label
  from (select doc_id, n, unnest(range(n)) as t from span_docs) a, (values (0), (1), (2)) x(annotator)
  where (doc_id * 7 + t * 13) % 5 = 0 and (t + annotator * 3 + doc_id) % 5 <> 0),
span_tokens as (select *, unnest(range(first, last + 1))::integer as tok_idx from spans)"""

RATINGS = """last_items as (
  select item_id, anno_01, anno_02, anno_03 from (select *, row_number() over (partition by item_id order by exported_at desc, anno_01 desc nulls last, anno_02 desc nulls last, anno_03 desc nulls last) as rn from events_event_type) where rn = 1),
ratings as (
  select coder, item_id as item, case when lower(trim(label)) not in ('', '-', 'na', 'missing') then lower(trim(label)) end as label
  from (select item_id, 'anno_01' as coder, anno_01 as label from last_items union all select item_id, 'anno_02', anno_02 from last_items union all select item_id, 'anno_03', anno_03 from last_items)),
complete as (select r.* from ratings r join (select item from ratings group by item having count(label) = 3) c using (item)),
votes as (select * from ratings where label is not null)"""
