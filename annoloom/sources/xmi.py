"""XMI documents, plain or in zips, to linked tables. The schema is explicit: id lists are text and must not be inferred as numbers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators.relations import by_id_list

_SPAN = "`_xmi:id`: bigint, _begin: int, _end: int"
_LINK = "array<struct<`_xmi:id`: bigint, _role: string, _target: bigint>>"
_PAIR = f"array<struct<{_SPAN}, _Governor: bigint, _Dependent: bigint>>"
_UNIT = f"array<struct<{_SPAN}>>"
SCHEMA = f"""`cas:Sofa` array<struct<_sofaString: string>>, `type2:DocumentMetaData` array<struct<_documentTitle: string, _documentId: string>>, `type4:Sentence` {_UNIT}, `type4:Token` {_UNIT},
 `custom:A_Event` array<struct<{_SPAN}, _a_Type: string, _b_Subtype: string, _c_Participant: string, _d_FILLER: string, _f_Discontiguous: string, _e_OtherModalityFactuality: string, _f_NegativePolarityFactuality: string, _i_Polarity: string>>,
 `custom:B_Participant` {_UNIT}, `custom:C_FILLER` {_UNIT}, `custom:D_Discontiguous` {_UNIT},
 `custom:A_EventC_ParticipantLink` {_LINK}, `custom:A_EventD_FILLERLink` {_LINK}, `custom:A_EventF_DiscontiguousLink` {_LINK}, `custom:CorefEvent` {_PAIR}, `custom:PronomCanonRef` {_PAIR},
 `custom:E_Sentiment` array<struct<{_SPAN}, _e_Polarity: string, _c_Uncertain: string, _d_Negated: string, _a_Target: string, _b_TargetEvent: string>>, `custom:E_SentimentA_TargetLink` {_LINK}, `custom:E_SentimentB_TargetEventLink` {_LINK}"""

_LAYERS = {"participant": "custom:B_Participant", "filler": "custom:C_FILLER", "discontiguous": "custom:D_Discontiguous"}
_LINKS = {"participant": "custom:A_EventC_ParticipantLink", "filler": "custom:A_EventD_FILLERLink", "discontiguous": "custom:A_EventF_DiscontiguousLink", "sentiment_target": "custom:E_SentimentA_TargetLink", "sentiment_event": "custom:E_SentimentB_TargetEventLink"}


def read_files(spark: SparkSession, path: str, pattern: str = "*.xmi") -> DataFrame:
    """(path, member, content): files of that name under path, and members of that name of its zips; what is no readable zip gives no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: list[tuple[str, bytes]] = []
                if fnmatch(name, pattern):
                    found.append((name.rsplit("/", 1)[-1], blob))
                elif name.endswith(".zip") and zipfile.is_zipfile(io.BytesIO(blob)):
                    with zipfile.ZipFile(io.BytesIO(blob)) as z:
                        found += [(m, z.read(m)) for m in sorted(z.namelist()) if fnmatch(m, pattern)]
                for member, data in found:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member]), pa.array([data.decode("utf-8", "replace")])], ["path", "member", "content"])

    return files.mapInArrow(run, "path string, member string, content string")


def parse(files: DataFrame) -> DataFrame:
    """One row a document: doc_uid (title and annotator, the member's stem), title, annotator_id, text and the raw layers in doc. Content that is no XMI has a null text."""
    parsed = files.withColumn("doc", F.from_xml("content", SCHEMA))
    annotator = F.regexp_replace(F.regexp_extract("member", r"([^/]*)$", 1), r"\.xmi$", "")
    title = F.get(F.col("doc")["type2:DocumentMetaData"], F.lit(0))["_documentTitle"]
    return parsed.select(
        F.concat_ws("|", title, annotator).alias("doc_uid"), "path", "member", title.alias("title"), F.split_part(title, F.lit("_"), F.lit(1)).alias("document_id"), annotator.alias("annotator_id"),
        F.get(F.col("doc")["cas:Sofa"], F.lit(0))["_sofaString"].alias("text"), "doc",
    )


def _rows(docs: DataFrame, layer: str, *columns: Column) -> DataFrame:
    rows = docs.select("doc_uid", "text", F.posexplode(F.col("doc")[layer]).alias("ord", "x"))
    span = [F.col("x._xmi:id").alias("element_id"), F.col("x._begin").alias("begin_pos"), F.col("x._end").alias("end_pos"), F.expr("substring(text, x._begin + 1, x._end - x._begin)").alias("text")]
    return rows.select("doc_uid", "ord", *span, *columns)


def tokens(docs: DataFrame) -> DataFrame:
    return _rows(docs, "type4:Token").withColumnRenamed("ord", "tok_idx")


def sentences(docs: DataFrame) -> DataFrame:
    return _rows(docs, "type4:Sentence").withColumnRenamed("ord", "sent_idx")


def events(docs: DataFrame) -> DataFrame:
    """Events with their types, factuality, sentiment and the lists of their links' ids."""
    x = F.col("x")
    raw = _rows(
        docs, "custom:A_Event", x["_a_Type"].alias("event_type"), x["_b_Subtype"].alias("event_subtype"), scalars.polarity(x["_f_NegativePolarityFactuality"]).alias("polarity_negation"), scalars.modality(x["_e_OtherModalityFactuality"]).alias("modality"),
        scalars.sentiment(x["_i_Polarity"]).alias("polarity_sentiment"), x["_c_Participant"].alias("participant_ids"), x["_d_FILLER"].alias("filler_ids"), x["_f_Discontiguous"].alias("discontiguous_ids"),
    )
    return raw.withColumns({
        "event_fulltype": scalars.full_type(F.col("event_type"), F.col("event_subtype")), "realis": scalars.realis(F.col("polarity_negation"), F.col("modality")),
        "polarity_sentiment_scoped": scalars.scoped_sentiment(F.col("polarity_sentiment"), F.col("polarity_negation") == "negative"),
    })


def links(docs: DataFrame, layer: str) -> DataFrame:
    return docs.select("doc_uid", F.explode(F.col("doc")[_LINKS[layer]]).alias("x")).select("doc_uid", F.col("x._xmi:id").alias("link_id"), F.col("x._role").alias("role"), F.col("x._target").alias("element_id"))


def units(docs: DataFrame, layer: str) -> DataFrame:
    """Participants and fillers, one row a link; discontiguous triggers with their first link or null; sentiment_target and sentiment_event as sentiment_targets() and sentiment_events()."""
    if layer == "sentiment_target":
        return sentiment_targets(docs)
    if layer == "sentiment_event":
        return sentiment_events(docs)
    rows, own = _rows(docs, _LAYERS[layer]), links(docs, layer)
    if layer == "discontiguous":
        return rows.join(own.groupBy("doc_uid", "element_id").agg(F.min("link_id").alias("link_id")), ["doc_uid", "element_id"], "left")
    return rows.join(own, ["doc_uid", "element_id"])


def event_units(docs: DataFrame, layer: str) -> DataFrame:
    """(doc_uid, event_id, link_id, element_id, ...) by the events' lists of link ids."""
    owners = events(docs).select("doc_uid", F.col("element_id").alias("event_id"), F.col(f"{layer}_ids").alias("ids"))
    return by_id_list(owners, "ids", units(docs, layer), ["doc_uid"], "link_id").drop("ids")


def pairs(docs: DataFrame, layer: str) -> DataFrame:
    """custom:CorefEvent or custom:PronomCanonRef as (doc_uid, governor, dependent, span)."""
    return _rows(docs, layer, F.col("x._Governor").alias("governor"), F.col("x._Dependent").alias("dependent"))


def sentiments(docs: DataFrame, flip_negated: bool = False) -> DataFrame:
    """Sentiment expressions; scoped sentiment as annotated, or changed under a negation where flip_negated is set."""
    x = F.col("x")
    raw = _rows(docs, "custom:E_Sentiment", scalars.sentiment(x["_e_Polarity"]).alias("polarity_sentiment"), x["_c_Uncertain"].alias("uncertain"), x["_d_Negated"].alias("negated"), x["_a_Target"].alias("target_ids"), x["_b_TargetEvent"].alias("event_ids"))
    negated = (F.col("negated") == "true") if flip_negated else F.lit(False)
    return raw.withColumn("polarity_sentiment_scoped", scalars.scoped_sentiment(F.col("polarity_sentiment"), negated))


def sentiment_targets(docs: DataFrame) -> DataFrame:
    """(doc_uid, sentiment_id, place, link_id, element_id, role, begin_pos, end_pos, text): what sentiment expressions aim at, by their lists of link ids.

    The target is the participant of an event with that id, with the role of its least link; a participant no event has
    is one of role sentiment_target. Unknown links and targets give no row.
    """
    listed = sentiments(docs).select("doc_uid", F.col("element_id").alias("sentiment_id"), F.col("target_ids").alias("ids"))
    ids = listed.select("doc_uid", "sentiment_id", F.posexplode(F.split(F.trim("ids"), r"\s+")).alias("place", "id")).select("doc_uid", "sentiment_id", "place", F.col("id").try_cast("long").alias("link_id"))
    aimed = ids.join(links(docs, "sentiment_target").drop("role"), ["doc_uid", "link_id"])
    roles = links(docs, "participant").groupBy("doc_uid", "element_id").agg(F.min_by("role", "link_id").alias("role"))
    people = _rows(docs, _LAYERS["participant"]).drop("ord").join(roles, ["doc_uid", "element_id"], "left").withColumn("role", F.coalesce("role", F.lit("sentiment_target")))
    return aimed.join(people, ["doc_uid", "element_id"]).select("doc_uid", "sentiment_id", "place", "link_id", "element_id", "role", "begin_pos", "end_pos", "text")


def sentiment_events(docs: DataFrame) -> DataFrame:
    """(doc_uid, sentiment_id, link_id, element_id, event_fulltype, text): the events sentiment expressions aim at; unknown links and events give no row."""
    listed = sentiments(docs).select("doc_uid", F.col("element_id").alias("sentiment_id"), F.col("event_ids").alias("ids"))
    aimed = by_id_list(listed, "ids", links(docs, "sentiment_event").drop("role"), ["doc_uid"], "link_id").drop("ids")
    return aimed.join(events(docs).select("doc_uid", "element_id", "event_fulltype", "text"), ["doc_uid", "element_id"]).select("doc_uid", "sentiment_id", "link_id", "element_id", "event_fulltype", "text")


def counts(docs: DataFrame) -> DataFrame:
    """How many elements of each layer a document has."""
    n = lambda layer: F.size(F.coalesce(F.col("doc")[layer], F.array())).cast("long")
    return docs.select(
        "doc_uid", n("type4:Token").alias("n_tokens"), n("type4:Sentence").alias("n_sentences"), n("custom:A_Event").alias("n_events"), n("custom:B_Participant").alias("n_participants"), n("custom:C_FILLER").alias("n_fillers"),
        n("custom:D_Discontiguous").alias("n_discontiguous"), n("custom:CorefEvent").alias("n_coref"), n("custom:PronomCanonRef").alias("n_canonref"), n("custom:E_Sentiment").alias("n_sentiments"),
    )
