"""English stems by the public Snowball (Porter2) description, as an Arrow-batched UDF over distinct words of a batch."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the algorithm: exceptions, suffixes and what they become.
WHOLE = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

_V = "[aeiouy]"
_REGION = re.compile(rf"^.*?{_V}[^aeiouy]")
_SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_DOUBLE = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_HAS_VOWEL = re.compile(_V)


def _after(word: str, start: int) -> int:
    m = _REGION.match(word[start:])
    return start + m.end() if m else len(word)


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of one word in lower case; words of one or two letters stay."""
    w = word.lower().replace("’", "'")
    if len(w) < 3:
        return w
    if w in WHOLE:
        return WHOLE[w]
    w = re.sub(rf"(^|{_V})y", lambda m: m[1] + "Y", w.removeprefix("'"))
    prefix = re.match("gener|commun|arsen", w)
    r1 = prefix.end() if prefix else _after(w, 0)
    r2 = _after(w, r1)
    w = w.removesuffix("'").removesuffix("'s") if not w.endswith("'s'") else w[:-3]

    # 1a: plurals
    end = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and _HAS_VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w.lower()

    # 1b: past and progressive forms
    end = _longest(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and _HAS_VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT_END.search(w):
            w += "e"

    # 1c: a last y after a consonant that isn't the first letter
    w = re.sub(r"(?<=.)(?<=[^aeiouy])[yY]$", "i", w)

    # 2 and 3: derivational endings in the first region
    for table in (STEP_2, STEP_3):
        end = _longest(w, table)
        before = w[: len(w) - len(end)]
        if end and len(before) >= r1:
            if end == "li":
                fits = before[-1:] in tuple("cdeghkmnrt")
            elif end == "ogi":
                fits = before.endswith("l")
            else:
                fits = end != "ative" or len(before) >= r2
            if fits:
                w = before + table[end]

    # 4: endings in the second region
    end = _longest(w, STEP_4)
    before = w[: len(w) - len(end)]
    if end and len(before) >= r2 and (end != "ion" or before.endswith(("s", "t"))):
        w = before

    # 5: a last e, a last double l
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(StringType())
def _stems(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join(map(stem, t.split())), na_action="ignore")


def stemmed(text: Column) -> Column:
    """The stems of a text's words, joined by blanks; null stays null."""
    return _stems(text)
