"""English stemming (the published Porter2 rules) for search tokens."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The usual 127 English stop words of full-text search.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she "
    "her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now"
).split()

# The suffix tables and exception words of the published algorithm.
_STEP2 = {
    "ational": "ate", "ization": "ize", "fulness": "ful", "ousness": "ous", "iveness": "ive",
    "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ness": "", "ful": "",
}
_STEP4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive",
    "ize", "al", "er", "ic",
)
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky",
    "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_VOWEL = "aeiouy"
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _region(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _short_syllable_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWEL and w[1] not in _VOWEL
    return len(w) > 2 and w[-3] not in _VOWEL and w[-2] in _VOWEL and w[-1] not in _VOWEL + "wxY"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = re.sub(r"(^|(?<=[aeiouy]))y", "Y", word)
    prefix = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(w, 0)
    r2 = _region(w, r1)

    # plural endings
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWEL for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w

    # -ed, -ing
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and any(c in _VOWEL for c in w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
            w = w[:-1]
        elif _short_syllable_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"

    end = _longest(w, (*_STEP2, "ogi", "li"))
    if end and len(w) - len(end) >= r1:
        stemmed = w[: -len(end)]
        if end == "ogi":
            w = w[:-1] if stemmed.endswith("l") else w
        elif end == "li":
            w = stemmed if stemmed and stemmed[-1] in "cdeghkmnrt" else w
        else:
            w = stemmed + _STEP2[end]

    end = _longest(w, (*_STEP3, "ative"))
    if end and len(w) - len(end) >= r1:
        if end == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(end)] + _STEP3[end]

    end = _longest(w, (*_STEP4, "ion"))
    if end and len(w) - len(end) >= r2:
        if end != "ion" or w[:-3].endswith(("s", "t")):
            w = w[: -len(end)]

    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_syllable_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem_all(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def search_tokens(tokens: Column) -> Column:
    """Drop stop words, stem the rest; occurrences are kept."""
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    return _stem_all(F.filter(tokens, lambda t: ~F.array_contains(stops, t)))
