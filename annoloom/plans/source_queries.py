"""Queries over an XMI document held here as text, and over scalar functions on small relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fuzzy import weighted_ratio
from ..sources import xmi

XMI = """<?xml version="1.0" encoding="UTF-8"?>
<xmi:XMI xmlns:xmi="http://www.omg.org/XMI" xmlns:cas="http:///uima/cas.ecore" xmlns:custom="http:///custom.ecore" xmlns:type2="http:///a/b.ecore" xmlns:type4="http:///a/c.ecore" xmi:version="2.0">
 <type2:DocumentMetaData xmi:id="1" sofa="12" begin="0" end="41" documentTitle="abcd01_one-two.txt" documentId="anno_07"/>
 <type4:Sentence xmi:id="2" sofa="12" begin="0" end="21"/><type4:Sentence xmi:id="3" sofa="12" begin="22" end="41"/>
 <type4:Token xmi:id="10" sofa="12" begin="0" end="4"/><type4:Token xmi:id="11" sofa="12" begin="5" end="9"/><type4:Token xmi:id="13" sofa="12" begin="10" end="20"/>
 <custom:A_Event xmi:id="20" sofa="12" begin="5" end="9" a_Type="Growth" b_Subtype="Profit" c_Participant="31 32" d_FILLER="" f_Discontiguous="35" e_OtherModalityFactuality="false" f_NegativePolarityFactuality="false" i_Polarity="+Positive"/>
 <custom:A_Event xmi:id="21" sofa="12" begin="22" end="26" a_Type="Growth" c_Participant="33" d_FILLER="34" f_Discontiguous="" e_OtherModalityFactuality="true" f_NegativePolarityFactuality="true" i_Polarity="-Negative"/>
 <custom:B_Participant xmi:id="25" sofa="12" begin="0" end="4"/><custom:B_Participant xmi:id="26" sofa="12" begin="10" end="20"/><custom:B_Participant xmi:id="27" sofa="12" begin="30" end="34"/>
 <custom:C_FILLER xmi:id="28" sofa="12" begin="37" end="43"/><custom:D_Discontiguous xmi:id="29" sofa="12" begin="10" end="13"/>
 <custom:A_EventC_ParticipantLink xmi:id="31" role="Actor" target="25"/><custom:A_EventC_ParticipantLink xmi:id="32" role="Thing" target="26"/><custom:A_EventC_ParticipantLink xmi:id="33" role="Actor" target="26"/>
 <custom:A_EventD_FILLERLink xmi:id="34" role="TIME" target="28"/><custom:A_EventF_DiscontiguousLink xmi:id="35" role="part" target="29"/>
 <custom:E_Sentiment xmi:id="50" sofa="12" begin="10" end="20" e_Polarity="+Positive" c_Uncertain="false" d_Negated="true" a_Target="51 52 99" b_TargetEvent="53"/>
 <custom:E_SentimentA_TargetLink xmi:id="51" target="26"/><custom:E_SentimentA_TargetLink xmi:id="52" target="27"/><custom:E_SentimentB_TargetEventLink xmi:id="53" target="21"/>
 <custom:CorefEvent xmi:id="40" sofa="12" begin="5" end="9" Dependent="20" Governor="21"/>
 <cas:Sofa xmi:id="12" sofaNum="1" mimeType="text" sofaString="Acme grew everywhere. Then Acme fell on Monday."/>
</xmi:XMI>"""


def _docs(spark: SparkSession) -> DataFrame:
    return xmi.parse(spark.createDataFrame([("memory", "anno_07.xmi", XMI)], "path string, member string, content string"))


def xmi_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xmi.counts(_docs(spark))


def xmi_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xmi.events(_docs(spark)).select("element_id", "text", "event_fulltype", "polarity_negation", "modality", "realis", "polarity_sentiment", "polarity_sentiment_scoped")


def xmi_event_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark)
    layers = [xmi.event_units(docs, k).select(F.lit(k).alias("layer"), "event_id", "link_id", "element_id", "text") for k in ("participant", "filler", "discontiguous")]
    return layers[0].unionByName(layers[1]).unionByName(layers[2])


def xmi_sentiment_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xmi.sentiment_targets(_docs(spark)).select("sentiment_id", "place", "link_id", "element_id", "role", "text")


def xmi_sentiment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xmi.sentiment_events(_docs(spark)).select("sentiment_id", "link_id", "element_id", "event_fulltype", "text")


def fuzzy_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import table

    return table(spark, sf_dir, "part").select("p_partkey", weighted_ratio(F.col("p_name"), F.col("p_type")).alias("score"))


QUERIES = {f.__name__: f for f in (xmi_ingest_counts, xmi_events, xmi_event_units, xmi_sentiment_targets, xmi_sentiment_events, fuzzy_similarity)}

_DOC = "'abcd01_one-two.txt|anno_07' as doc_uid"
ORACLES = {
    "xmi_ingest_counts": f"select {_DOC}, 3::bigint as n_tokens, 2::bigint as n_sentences, 2::bigint as n_events, 3::bigint as n_participants, 1::bigint as n_fillers, 1::bigint as n_discontiguous, 1::bigint as n_coref, 0::bigint as n_canonref, 1::bigint as n_sentiments",
    "xmi_events": "select * from (values (20::bigint, 'grew', 'Growth.Profit', 'positive', 'certain', 'asserted', 'positive', 'positive'), (21, 'Then', 'Growth.None', 'negative', 'other', 'other', 'negative', 'positive')) v(element_id, text, event_fulltype, polarity_negation, modality, realis, polarity_sentiment, polarity_sentiment_scoped)",
    "xmi_event_units": "select * from (values ('participant', 20::bigint, 31::bigint, 25::bigint, 'Acme'), ('participant', 20, 32, 26, 'everywhere'), ('participant', 21, 33, 26, 'everywhere'), ('filler', 21, 34, 28, 'on Mon'), ('discontiguous', 20, 35, 29, 'eve')) v(layer, event_id, link_id, element_id, text)",
    "xmi_sentiment_targets": "select * from (values (50::bigint, 0, 51::bigint, 26::bigint, 'Thing', 'everywhere'), (50, 1, 52, 27, 'sentiment_target', 'e fe')) v(sentiment_id, place, link_id, element_id, role, text)",
    "xmi_sentiment_events": "select 50::bigint as sentiment_id, 53::bigint as link_id, 21::bigint as element_id, 'Growth.None' as event_fulltype, 'Then' as text",
}
