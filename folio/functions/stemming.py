"""Stemming of index and query words, and the stop words.

Both variants follow the same rules of suffixes and differ only in how much of a suffix the fourth rule removes: the
index removes two letters (four of "-ment"), the query the whole suffix, so some words differ between index and query.
Words are reduced to their shape, a string of c and v, on which all conditions are regular expressions.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Stop words of the index.
STOP_WORDS = (
    "a an the and or but in on at to for of by with from is are was were be been being have has had do does did will would can could shall should may might must "
    "this that these those it its they them their we us our you your he him his she her not no nor neither very too so such if then else when where why how what "
    "which who whom as than about after before between over under through into onto upon within without all each every some any more most other another both many "
    "few several just also only even still already yet once here there like same well much because while since until up down out off away back ago now"
).split()
# Stop words of retrieval.
RETRIEVAL_STOP_WORDS = "what are is a an the of to how do does did can will i this that about and or for any it its in on with your you me my we project projects there some".split()

# Suffix replacements of rules two and three, each applied in turn; suffixes of rule four in the order of trial.
SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_VOWEL_Y = re.compile("(?<=c)y")


@lru_cache(maxsize=200_000)
def shape(word: str) -> str:
    """c for a consonant and v for a vowel at each place; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return shape(word).count("vc")


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def _chain(word: str, rules: dict[str, str]) -> str:
    for suffix, new in rules.items():
        word = word.removesuffix(suffix) + new if word.endswith(suffix) else word
    return word


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word if word.endswith("ss") else word.removesuffix("s")


def _tense(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) else word
    for suffix in ("ed", "ing"):
        base = word.removesuffix(suffix)
        if base != word and "v" in shape(base):
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if len(base) > 1 and base[-1] == base[-2] and shape(base)[-1] == "c":
                return base if base[-1] in "lsz" else base[:-1]
            return base + "e" if measure(base) == 1 and _short(base) else base
    return word


def _fourth(word: str, whole: bool) -> str:
    long = measure(word) > 1
    suffix = next((s for s in FOURTH if word.endswith(s)), None)
    if suffix is not None and (long or not whole):
        if not long:
            return word
        return word[: -len(suffix)] if whole else word[: -4 if word.endswith("ment") else -2]
    if whole and word.endswith(("sion", "tion")) and measure(word[:-3]) > 1:
        return word[:-3]
    return word[:-4] if long and word.endswith(("ance", "ence")) else word


def stem(word: str, query: bool = False) -> str:
    """The stem of a word in a-z and 0-9: as the index stores it, or as a query looks it up."""
    word = word.lower()
    if len(word) <= 2:
        return word
    word = _tense(_plural(word))
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for rules, least in ((SECOND, 4), (THIRD, 3)):
        if len(word) >= least and measure(word[:-1]) > 0:
            word = _chain(word, rules)
    if len(word) >= 2:
        word = _fourth(word, query)
    if word.endswith("e"):
        base = word[:-1]
        if measure(base) > 1 or measure(base) == 1 and not _short(base):
            word = base
    if len(word) >= 4 and word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=300_000)
def remembered(word: str, query: bool = False) -> str:
    return stem(word, query)


def stems(words: Column, query: bool = False) -> Column:
    """Stems of a string column; null for null. Apply it to distinct words where there are many repeats."""

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda w: None if w is None else remembered(w, query))

    return run(words)


def is_stop_word(word: Column) -> Column:
    return word.isin(STOP_WORDS)
