"""English (Snowball) stems for a column of distinct lower-case words.

Follows the published description of the English Snowball stemmer. It is meant
for a vocabulary, one row per distinct word, never for running text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whole words with their own stem, and words left alone.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
INVARIANT = set("sky news howe atlas cosmos bias andes".split())
INVARIANT_AFTER_PLURAL = set("inning outing canning herring earring proceed exceed succeed".split())

# Suffix -> replacement, for the steps that look in the first region.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "", "ative": "",
}
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

VOWEL = "[aeiouy]"
SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
REGION = re.compile(rf"{VOWEL}[^aeiouy]")


def _suffix(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _regions(word: str) -> tuple[int, int]:
    """Start of the first and second region of a word."""
    prefix = re.match("gener|commun|arsen", word)
    found = prefix or REGION.search(word)
    first = found.end() if found else len(word)
    found = REGION.search(word, first)
    return first, found.end() if found else len(word)


def stem(word: str) -> str:
    """Stem of one lower-case word."""
    if len(word) <= 2 or word in INVARIANT:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = re.sub(rf"^y|(?<={VOWEL})y", "Y", word)
    r1, r2 = _regions(word)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(VOWEL, word[:-2]):
        word = word[:-1]
    if word in INVARIANT_AFTER_PLURAL:
        return word

    ending = _suffix(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and re.search(VOWEL, word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif SHORT_END.search(word) and r1 >= len(word):
            word += "e"

    word = re.sub(r"(?<=.[^aeiouy])[yY]$", "i", word)

    ending = _suffix(word, STEP2)
    if ending and len(word) - len(ending) >= r1:
        before = word[: -len(ending)]
        if (ending != "ogi" or before.endswith("l")) and (ending != "li" or re.search("[cdeghkmnrt]$", before)):
            word = before + STEP2[ending]

    ending = _suffix(word, STEP3)
    if ending and len(word) - len(ending) >= (r2 if ending == "ative" else r1):
        word = word[: -len(ending)] + STEP3[ending]

    ending = _suffix(word, STEP4)
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or re.search("[st]ion$", word)):
        word = word[: -len(ending)]

    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not SHORT_END.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


@F.pandas_udf(T.StringType())
def stem_words(words: pd.Series) -> pd.Series:
    return words.map(stem)


def with_stems(vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """Add ``stem`` to a table of distinct words."""
    return vocabulary.withColumn("stem", stem_words(F.col(word)))
