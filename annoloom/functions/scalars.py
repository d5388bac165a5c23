"""Scalar mappings and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the raw flags, weights of parts of speech, cues of edges.
SENTIMENTS = {"=Neutral": "neutral", "+Positive": "positive", "-Negative": "negative"}
PRONOUN_TAGS = ("PRP", "PRP$", "WDT", "WP", "WP$")
CONTENT_WEIGHTS = {"ADJ": 1.0, "VERB": 1.0, "ADV": 1.0, "NUM": 1.0, "NOUN": 1.0, "ADP": 1.0, "AUX": 0.5, "PROPN": 0.5}
TRUNCATION_POS = {"ADJ": 1.0, "VERB": 1.0, "NUM": 1.0, "PROPN": 1.0, "NOUN": 1.5}
TRUNCATION_DEP = {"nsubj": 0.5, "ROOT": 0.5, "amod": 0.5, "quantmod": 0.5}
TRUNCATION_ROOT = 1.0
TRUNCATION_START = {"DET": -0.5, "PUNCT": -1.25, "ADP": -1.25, "CCONJ": -1.25}
TRUNCATION_END = {"PUNCT": -0.5, "ADP": -0.5, "CCONJ": -0.5}


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, v)))


def flag_name(flag: Column, when_true: str, when_false: str) -> Column:
    """'true' and 'false' as words, other values and null as they are."""
    return F.when(flag == "true", when_true).when(flag == "false", when_false).otherwise(flag)


def modality(flag: Column) -> Column:
    return flag_name(flag, "other", "certain")


def polarity(flag: Column) -> Column:
    return flag_name(flag, "negative", "positive")


def realis(polarity_name: Column, modality_name: Column) -> Column:
    """asserted for what is positive and certain, else other."""
    return F.when((polarity_name == "positive") & (modality_name == "certain"), "asserted").otherwise("other")


def sentiment(label: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(SENTIMENTS), label), label)


def scoped_sentiment(sentiment_name: Column, negated: Column) -> Column:
    """Positive and negative change places under a negation; negated is a boolean column, null as false."""
    flipped = F.when(sentiment_name == "positive", "negative").when(sentiment_name == "negative", "positive").otherwise(sentiment_name)
    return F.when(negated, flipped).otherwise(sentiment_name)


def full_type(main: Column, sub: Column) -> Column:
    return F.concat(main, F.lit("."), F.coalesce(sub, F.lit("None")))


def pronominal(tags: Column) -> Column:
    """All of a span's tags are pronoun tags; an empty or null span is not pronominal."""
    return (F.size(F.coalesce(tags, F.array())) > 0) & F.forall(tags, lambda t: t.isin(*PRONOUN_TAGS))


def weight_sum(items: Column, weights: dict[str, float]) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at(_map(weights), x), F.lit(0.0)))


def content_score(pos: Column) -> Column:
    """How much content a run of parts of speech has."""
    return weight_sum(pos, CONTENT_WEIGHTS)


def truncated(tokens: Column, width: int, argument: bool = False) -> Column:
    """The window of `width` tokens (array of struct pos, dep, root) of most content as its first place from 0; null where none scores above 0 or it is shorter.

    Parts of speech and dependencies add up, the span's root (root: its head lies outside the span) whatever its
    dependency; a window gains by a number at its start (arguments) and loses by loose ends. The first of equal ones.
    """
    n = F.size(tokens) - width
    starts = F.when(n >= 0, F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    at = lambda m, x: F.coalesce(F.try_element_at(_map(m), x), F.lit(0.0))

    def score(i: Column) -> Column:
        w = F.slice(tokens, i + 1, width)
        inner = F.aggregate(w, F.lit(0.0), lambda s, t: s + at(TRUNCATION_POS, t["pos"]) + at(TRUNCATION_DEP, t["dep"]) + F.when(t["root"], TRUNCATION_ROOT).otherwise(0.0))
        start, end = F.get(w, F.lit(0))["pos"], F.get(w, F.lit(width - 1))["pos"]
        number = F.when(start == "NUM", 1.5).otherwise(0.0) if argument else F.lit(0.0)
        return inner + number + at(TRUNCATION_START, start) + at(TRUNCATION_END, end)

    scores = F.transform(starts, score)
    return F.when(F.array_max(scores) > 0, F.array_position(scores, F.array_max(scores)) - 1)


def safe_list(text: Column, element: str = "string") -> Column:
    """A list written in JSON or with single quotes; null for anything else."""
    return F.from_json(F.translate(text, "'", '"'), f"array<{element}>")


def zip_text(a: Column, b: Column, joint: str = "_") -> Column:
    return F.zip_with(a, b, lambda x, y: F.concat_ws(joint, x, y))


def short_text(text: Column, most: int = 32) -> Column:
    """A text of more than `most` characters as its ends around an ellipsis."""
    half = (most - 3) // 2
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, half), F.lit("..."), F.substring(text, -half, half))).otherwise(text)
