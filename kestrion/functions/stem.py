"""The Porter stemmer of the published algorithm (M. F. Porter, 1980), applied to distinct terms only."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

# The algorithm's suffix tables.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LONGEST = 64
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """One letter for each of the word's: v for vowels (y after a consonant is one), c for consonants."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """How often a run of vowels is followed by consonants."""
    return len(re.findall("v+c+", shape(stem)))


def has_vowel(stem: str) -> bool:
    return "v" in shape(stem)


def double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def short_end(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two bytes stay, and so do those of more than 64.

    Letters beyond ASCII count as consonants, one for each of their bytes in UTF-8, as in SQLite's full-text search.
    """
    raw = word if word.isascii() else word.encode().decode("latin-1")
    if not 3 <= len(raw) <= LONGEST:
        return word
    out = stem_bytes(raw)
    return out if raw is word else out.encode("latin-1").decode(errors="replace")


def stem_bytes(word: str) -> str:
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix) and len(word) > len(suffix):
            word = word[: -len(suffix)] + new
            break
    if word.endswith("eed"):
        if measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s)), None)
        if cut is not None and has_vowel(cut):
            word = cut
            if word.endswith(("at", "bl", "iz")) or (measure(word) == 1 and short_end(word)):
                word += "e"
            elif double_end(word) and word[-1] not in "lsz":
                word = word[:-1]
    if word.endswith("y") and has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        suffix = longest(word, table)
        if suffix and measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + table[suffix]
    suffix = longest(word, STEP4)
    if suffix and measure(word[: -len(suffix)]) > 1 and (suffix != "ion" or word[-4] in "st"):
        word = word[: -len(suffix)]
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def stems(words: pd.Series) -> pd.Series:
    return words.map(stem)


def stem_table(terms: DataFrame) -> DataFrame:
    """term, stem of distinct terms."""
    return terms.select("term", stems("term").alias("stem"))
