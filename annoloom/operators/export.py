"""Nested and tagged exports of spans for model training, and offsets for other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spans import bio_tags, span_tokens


def bio_text(tokens: DataFrame, units: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, bio): 'token\\TAG' joined by blanks in token order, one row a document."""
    tagged = bio_tags(tokens, units, keys, order)
    return tagged.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", F.concat("tok", F.lit("\\"), "tag").alias("s")))), lambda x: x["s"]), " ").alias("bio"))


def triples(units: DataFrame, targets: DataFrame) -> DataFrame:
    """Opinion triples of one sentence: (doc_id, sent_idx, triple_no, target_id, sentiment, n_opinions, opinion_ids). units and targets: doc_id, sent_idx, span_id, first, last; units: label.

    A unit goes with each target of its sentence; triples are numbered by the first unit, then the target.
    """
    pairs = units.filter("sent_idx is not null").join(targets.select("doc_id", "sent_idx", F.col("span_id").alias("target_id")), ["doc_id", "sent_idx"])
    grouped = pairs.groupBy("doc_id", "sent_idx", "target_id", F.col("label").alias("sentiment")).agg(F.min("span_id").alias("first_unit"), F.array_sort(F.collect_set("span_id")).alias("opinion_ids"))
    number = F.row_number().over(Window.partitionBy("doc_id", "sent_idx").orderBy("first_unit", "target_id", "sentiment")) - 1
    return grouped.select("doc_id", "sent_idx", number.alias("triple_no"), "target_id", "sentiment", F.size("opinion_ids").cast("long").alias("n_opinions"), "opinion_ids")


def sentence_offsets(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, n_tokens, keep, pad, offset): a sentence of '.' alone is dropped, another one of one token padded by one; offset is what earlier ones add."""
    sizes = tokens.groupBy("doc_id", "sent_idx").agg(F.count("*").alias("n_tokens"), F.min("tok").alias("only"))
    keep = ~((F.col("n_tokens") == 1) & (F.col("only") == "."))
    pad = (F.col("n_tokens") == 1) & keep
    delta = F.when(~keep, -1).when(pad, 1).otherwise(0)
    w = Window.partitionBy("doc_id").orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("doc_id", "sent_idx", "n_tokens", keep.alias("keep"), pad.alias("pad"), F.coalesce(F.sum(delta).over(w), F.lit(0)).alias("offset"))


def ie_documents(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_key, doc): a JSON document of sentences and, aligned to them, events as [first, last, label] in document tokens with padding offsets."""
    sentences = tokens.groupBy("doc_id", "sent_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "tok"))), lambda x: x["tok"]).alias("toks"))
    offsets = sentence_offsets(tokens).filter("keep")
    events = spans.filter("sent_idx is not null").join(offsets.select("doc_id", "sent_idx", "offset"), ["doc_id", "sent_idx"]).groupBy("doc_id", "sent_idx").agg(
        F.array_sort(F.collect_list(F.struct((F.col("first") + F.col("offset")).alias("first"), (F.col("last") + F.col("offset")).alias("last"), "label"))).alias("events")
    )
    rows = sentences.join(offsets.select("doc_id", "sent_idx", "pad"), ["doc_id", "sent_idx"]).join(events, ["doc_id", "sent_idx"], "left")
    padded = F.when(F.col("pad"), F.concat("toks", F.array(F.lit(".")))).otherwise(F.col("toks"))
    per = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_idx", padded.alias("toks"), F.coalesce("events", F.array().cast("array<struct<first:bigint,last:bigint,label:string>>")).alias("events")))).alias("s"))
    doc = F.struct(F.col("doc_id").cast("string").alias("doc_key"), F.transform("s", lambda x: x["toks"]).alias("sentences"), F.transform("s", lambda x: x["events"]).alias("events"))
    return per.select(F.col("doc_id").alias("doc_key"), F.to_json(doc).alias("doc"))


def polar_instances(units: DataFrame, targets: DataFrame) -> DataFrame:
    """(instance_id, doc_id, sent_idx, label, first, last, hull_first, hull_last): a unit and the convex hull of it and its sentence's targets, with a running id."""
    hull = targets.groupBy("doc_id", "sent_idx").agg(F.min("first").alias("t_first"), F.max("last").alias("t_last"))
    number = F.row_number().over(Window.partitionBy("doc_id", "sent_idx").orderBy("first", "last", "span_id")) - 1
    joined = units.filter("sent_idx is not null").withColumn("k", number).join(hull, ["doc_id", "sent_idx"], "left")
    return joined.select(
        F.concat(F.col("doc_id").cast("string"), F.lpad(F.col("sent_idx").cast("string"), 4, "0"), F.lpad(F.col("k").cast("string"), 4, "0")).alias("instance_id"), "doc_id", "sent_idx", "label", "first", "last",
        F.least("first", "t_first").alias("hull_first"), F.greatest("last", "t_last").alias("hull_last"),
    )


def corpus_offsets(docs: DataFrame, spans: DataFrame, gap: int = 10, parts: int = 1024) -> DataFrame:
    """spans in one corpus-wide line of tokens: begin and end (half-open) after all earlier documents' lengths and a gap for each. docs: doc_id, n_tokens.

    The running sum goes over ranges of documents first, so that no task sorts them all.
    """
    size = F.coalesce("n_tokens", F.lit(0)) + gap
    bounds = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    step = max(1, -(-((bounds.hi or 0) - (bounds.lo or 0) + 1) // parts))
    placed = docs.select("doc_id", size.alias("size"), F.floor((F.col("doc_id") - (bounds.lo or 0)) / step).alias("part"))
    sums = placed.groupBy("part").agg(F.sum("size").alias("s")).select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("part").orderBy("doc_id")) - F.col("size")
    offset = placed.withColumn("inside", inside).join(sums, "part").select("doc_id", (F.col("before") + F.col("inside")).alias("offset"))
    return spans.join(offset, "doc_id").select("doc_id", "annotator", "span_id", "label", (F.col("first") + F.col("offset")).alias("begin"), (F.col("last") + 1 + F.col("offset")).alias("end"))


def token_labels(tokens: DataFrame, spans: DataFrame, annotators: list[int], none: str = "no_anno") -> DataFrame:
    """One row a token, one column for each annotator: the least label of the units that cover it, or `none`."""
    marks = span_tokens(spans).groupBy("doc_id", "tok_idx").pivot("annotator", annotators).agg(F.min("label"))
    joined = tokens.select("doc_id", "tok_idx").join(marks, ["doc_id", "tok_idx"], "left")
    return joined.select("doc_id", "tok_idx", *(F.coalesce(F.col(str(a)), F.lit(none)).alias(f"annotator_{a}") for a in annotators))


def _json_list(items) -> F.Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _quoted(text) -> F.Column:
    """A text as JSON: one value of a list, without the list's brackets."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _mixed(*parts) -> F.Column:
    """A JSON list of numbers and texts: [first, last, "label"]."""
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def ie_json(tokens: DataFrame, events: DataFrame, arguments: DataFrame, relations: DataFrame | None = None, ner: DataFrame | None = None, dataset: str = "data") -> DataFrame:
    """(doc_key, doc): a JSON document of lists aligned by sentence: sentences, events [[first,last,type],[first,last,role]...], ner, clusters, relations [first,last,first,last,label].

    tokens: doc_id, sent_idx, tok_idx, tok; events: doc_id, sent_idx, span_id, first, last, label; arguments: doc_id,
    span_id (the event's), sent_idx, first, last, role, of which those in the event's sentence count, by the stem of their
    role; relations: doc_id, sent_idx, first, last, to_first, to_last, label. Tokens are counted over the document with the
    offsets of padded and dropped sentences (on relations, as readers of this format expect, on their target only); spans
    that cross sentences and spans in dropped sentences are left out. ner: doc_key, ner, a JSON list aligned by sentence
    that some recognizer gave; documents without it have empty lists.
    """
    kept = sentence_offsets(tokens).filter("keep").select("doc_id", "sent_idx", "pad", "offset")
    words = tokens.groupBy("doc_id", "sent_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "tok"))), lambda x: x["tok"]).alias("toks"))
    place = lambda c: (F.col(c) + F.col("offset")).cast("string")
    stem = F.split_part(F.col("role"), F.lit("_"), F.lit(1))
    owned = arguments.join(events.select("doc_id", "span_id", "sent_idx"), ["doc_id", "span_id", "sent_idx"], "left_semi").join(kept, ["doc_id", "sent_idx"])
    args = owned.select("doc_id", "span_id", "first", "last", _mixed(place("first"), place("last"), _quoted(stem)).alias("j"), stem.alias("r")).distinct()
    args = args.groupBy("doc_id", "span_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "last", "r", "j"))), lambda x: x["j"]).alias("args"))
    own = events.filter("sent_idx is not null").join(kept, ["doc_id", "sent_idx"]).join(args, ["doc_id", "span_id"], "left")
    trigger = F.array(_mixed(place("first"), place("last"), _quoted(F.col("label"))))
    event = _json_list(F.concat(trigger, F.coalesce("args", F.array().cast("array<string>"))))
    per_sentence = own.select("doc_id", "sent_idx", "first", "last", "span_id", event.alias("j")).groupBy("doc_id", "sent_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "last", "span_id", "j"))), lambda x: x["j"]).alias("events"))
    rows = words.join(kept, ["doc_id", "sent_idx"]).join(per_sentence, ["doc_id", "sent_idx"], "left")
    if relations is not None:
        told = relations.join(kept, ["doc_id", "sent_idx"]).withColumn("j", _mixed(F.col("first").cast("string"), F.col("last").cast("string"), place("to_first"), place("to_last"), _quoted(F.col("label"))))
        rows = rows.join(told.groupBy("doc_id", "sent_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "last", "to_first", "to_last", "j"))), lambda x: x["j"]).alias("relations")), ["doc_id", "sent_idx"], "left")
    else:
        rows = rows.withColumn("relations", F.lit(None).cast("array<string>"))
    padded = F.transform(F.when(F.col("pad"), F.concat("toks", F.array(F.lit(".")))).otherwise(F.col("toks")), _quoted)
    none = F.array().cast("array<string>")
    per = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_idx", _json_list(padded).alias("s"), _json_list(F.coalesce("events", none)).alias("e"), _json_list(F.coalesce("relations", none)).alias("r")))).alias("x"))
    per = per.withColumn("doc_key", F.col("doc_id").cast("string"))
    per = per.join(ner.select("doc_key", "ner"), "doc_key", "left") if ner is not None else per.withColumn("ner", F.lit(None).cast("string"))
    column = lambda name: _json_list(F.transform("x", lambda y: y[name]))
    empty = _json_list(F.transform("x", lambda y: F.lit("[]")))
    doc = F.concat(
        F.lit('{"doc_key":'), _quoted(F.col("doc_key")), F.lit(',"dataset":'), _quoted(F.lit(dataset)), F.lit(',"sentences":'), column("s"), F.lit(',"events":'), column("e"),
        F.lit(',"ner":'), F.coalesce("ner", empty), F.lit(',"clusters":'), empty, F.lit(',"relations":'), column("r"), F.lit("}"),
    )
    return per.select("doc_key", doc.alias("doc"))


def _sentence_rows(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, start, words): a sentence's first token and its words."""
    per = tokens.groupBy("doc_id", "sent_idx").agg(F.min("tok_idx").alias("start"), F.array_sort(F.collect_list(F.struct("tok_idx", "tok"))).alias("t"))
    return per.select("doc_id", "sent_idx", "start", F.transform("t", lambda x: x["tok"]).alias("words"))


def _tagged(words, start, spans) -> F.Column:
    """'word\\TAG ...' of a sentence; of overlapping spans (array of struct first, last) the later one counts."""

    def tag(i):
        at = start + i
        return F.aggregate(spans, F.lit("O"), lambda s, x: F.when((at < x["first"]) | (at > x["last"]), s).when(at == x["first"], "B").otherwise("I"))

    return F.array_join(F.transform(words, lambda w, i: F.concat(w, F.lit("\\"), tag(i))), " ")


def tagged_triples(tokens: DataFrame, units: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, sentence, doc_id, sent_idx, uid, target_tags, opinion_tags, sentiment): a row for each triple; to_json over a group makes the nested form.

    units: doc_id, sent_idx, span_id, first, last, label; targets: doc_id, sent_idx, span_id, first, last. A unit goes with
    each target of its sentence; units of one target and label are one triple, tagged in order of their first token.
    """
    # Tags are made once for each label and each target of a sentence, not for each triple.
    sentences = _sentence_rows(tokens)
    grouped = units.filter("sent_idx is not null").groupBy("doc_id", "sent_idx", F.col("label").alias("sentiment")).agg(F.min("span_id").alias("first_unit"), F.array_sort(F.collect_set(F.struct("first", "span_id", "last"))).alias("opinions"))
    aims = targets.filter("sent_idx is not null").groupBy("doc_id", "sent_idx", F.col("span_id").alias("target_id")).agg(F.min("first").alias("first"), F.min("last").alias("last"))
    opinions = grouped.join(sentences, ["doc_id", "sent_idx"]).select("doc_id", "sent_idx", "sentiment", "first_unit", _tagged(F.col("words"), F.col("start"), F.col("opinions")).alias("opinion_tags"))
    tagged = aims.join(sentences, ["doc_id", "sent_idx"]).select("doc_id", "sent_idx", "target_id", F.array_join("words", " ").alias("sentence"), _tagged(F.col("words"), F.col("start"), F.array(F.struct("first", "last"))).alias("target_tags"))
    number = F.row_number().over(Window.partitionBy("doc_id", "sent_idx").orderBy("first_unit", "target_id", "sentiment")) - 1
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("sent_idx").cast("string"))
    return opinions.join(tagged, ["doc_id", "sent_idx"]).withColumn("n", number).select(key.alias("id"), "sentence", "doc_id", "sent_idx", F.concat_ws("-", key, F.col("n").cast("string")).alias("uid"), "target_tags", "opinion_tags", "sentiment")


def triple_documents(triples: DataFrame, keep_empty: DataFrame | None = None) -> DataFrame:
    """(id, doc): JSON {id, sentence, triples: [...]} of each sentence of tagged_triples(); with keep_empty (id, sentence) also of sentences without any."""
    per = triples.groupBy("id").agg(F.min("sentence").alias("sentence"), F.array_sort(F.collect_list(F.struct("uid", "target_tags", "opinion_tags", "sentiment"))).alias("triples"))
    if keep_empty is not None:
        bare = keep_empty.select("id", "sentence").join(per.select("id"), "id", "left_anti")
        per = per.unionByName(bare.withColumn("triples", F.array().cast(per.schema["triples"].dataType)))
    return per.select("id", F.to_json(F.struct("id", "sentence", "triples")).alias("doc"))


def polar_rows(tokens: DataFrame, units: DataFrame, targets: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """The ten columns of a polar instance: id, polarity, polarity_orig, sentence, polex, polex_targets, polex_span, polex_targets_span, target_spans, split; spans in places of the sentence.

    splits: doc_id, split; without one the split is empty. Units that cross sentences are left out.
    """
    aims = targets.select("doc_id", "sent_idx", "first", "last").distinct().groupBy("doc_id", "sent_idx").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("aims"))
    number = F.row_number().over(Window.partitionBy("doc_id", "sent_idx").orderBy("first", "last", "span_id")) - 1
    joined = units.filter("sent_idx is not null").withColumn("n", number).join(_sentence_rows(tokens), ["doc_id", "sent_idx"]).join(aims, ["doc_id", "sent_idx"], "left")
    joined = joined.withColumn("aims", F.coalesce("aims", F.array().cast("array<struct<first:int,last:int>>")))
    joined = joined.join(splits.select("doc_id", "split"), "doc_id", "left") if splits is not None else joined.withColumn("split", F.lit(""))
    two = lambda c: F.format_string("%02d", c)
    low = F.least("first", F.array_min(F.transform("aims", lambda x: x["first"]))).alias("low")
    high = F.greatest("last", F.array_max(F.transform("aims", lambda x: x["last"]))).alias("high")
    at = joined.select("*", low, high)
    text = lambda a, b: F.array_join(F.slice("words", F.col(a) - F.col("start") + 1, F.col(b) - F.col(a) + 1), " ")
    span = lambda a, b: F.concat(F.lit("("), (a - F.col("start")).cast("string"), F.lit(", "), (b - F.col("start")).cast("string"), F.lit(")"))
    return at.select(
        F.concat_ws(" ", F.col("doc_id").cast("string"), two(F.col("sent_idx")), two(F.col("n"))).alias("id"), F.col("label").alias("polarity"), F.col("label").alias("polarity_orig"), F.array_join("words", " ").alias("sentence"),
        text("first", "last").alias("polex"), text("low", "high").alias("polex_targets"), span(F.col("first"), F.col("last")).alias("polex_span"), span(F.col("low"), F.col("high")).alias("polex_targets_span"),
        F.concat(F.lit("["), F.array_join(F.transform("aims", lambda x: span(x["first"], x["last"])), ", "), F.lit("]")).alias("target_spans"), F.coalesce("split", F.lit("")).alias("split"),
    )


def json_array(df: DataFrame, column: str, order: str, by: str) -> DataFrame:
    """(by, array): one JSON array of the documents of each split, in order; for splits small enough to be one file."""
    return df.groupBy(by).agg(_json_list(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column])).alias("array"))
