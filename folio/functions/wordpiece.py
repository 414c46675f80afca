"""WordPiece ids with a given vocabulary: greedy longest pieces of the words of a text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def words_of(text: str) -> list[str]:
    """Lower case, marks removed, controls as spaces, split at spaces and around punctuation."""
    out, word = [], ""
    for c in unicodedata.normalize("NFD", text.lower()):
        kind = unicodedata.category(c)
        if kind == "Mn":
            continue
        if c.isspace() or kind in ("Cc", "Cf"):
            out.append(word)
            word = ""
        elif kind[0] == "P" or 33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126:
            out += [word, c]
            word = ""
        else:
            word += c
    return [w for w in [*out, word] if w]


def piece_ids(text: str, vocabulary: dict[str, int], limit: int, cls: str = "[CLS]", sep: str = "[SEP]", unknown: str = "[UNK]") -> list[int]:
    ids = [vocabulary[cls]]
    for word in words_of(text):
        pieces, start = [], 0
        while start < len(word):
            end = len(word)
            while end > start and ("##" if start else "") + word[start:end] not in vocabulary:
                end -= 1
            if end == start:
                pieces = [vocabulary[unknown]]
                break
            pieces.append(vocabulary[("##" if start else "") + word[start:end]])
            start = end
        ids += pieces
        if len(ids) >= limit - 1:
            break
    return [*ids[: limit - 1], vocabulary[sep]]


def encoded(text: Column, vocabulary: dict[str, int], limit: int = 128) -> Column:
    """Ids of each text, at most limit. The vocabulary, of known size, goes with the function."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: piece_ids(t or "", vocabulary, limit))

    return run(text)
