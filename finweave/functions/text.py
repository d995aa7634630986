"""Text normalisation and set similarities as native expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finweave.constants import ADDRESS_WORDS, LEGAL_FORMS


@lru_cache(1)
def _letters() -> tuple[str, str]:
    """Single letters outside ASCII that decompose to one ASCII character, and what they become."""
    pairs = []
    for point in (*range(0x80, 0x250), *range(0x1E00, 0x1F00)):
        plain = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            pairs.append((chr(point), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def ascii_fold(c: Column) -> Column:
    """Accents off Latin letters; whatever isn't ASCII then is dropped. Signs that expand to several letters need ``ascii_fold_exact``."""
    return F.regexp_replace(F.translate(c, *_letters()), r"[^\x00-\x7F]", "")


@F.pandas_udf(T.StringType())
def ascii_fold_exact(s: pd.Series) -> pd.Series:
    """NFKD with everything but ASCII dropped, for all of Unicode."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def entity_name(c: Column, fold=ascii_fold) -> Column:
    """Letters and single spaces in lower case without legal forms; null gives an empty text."""
    letters = F.lower(_squeezed(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[^A-Za-z\s]", "")))
    return _squeezed(F.regexp_replace(letters, rf"\b({'|'.join(LEGAL_FORMS)})\b", ""))


def entity_address(c: Column, fold=ascii_fold) -> Column:
    """Lower case with street words written out and marks as spaces; null gives an empty text."""
    out = F.lower(fold(F.coalesce(c, F.lit(""))))
    for short, long in ADDRESS_WORDS.items():
        out = F.regexp_replace(out, rf"\b{short}\b", long)
    return _squeezed(F.regexp_replace(out, r"[^\w\s]", " "))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))


def grams(c: Column, n: int = 2) -> Column:
    """Distinct character n-grams; a text shorter than n has none."""
    short = F.length(c) < n
    return F.when(short, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, n))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets: 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def dice(x: Column, y: Column, a: Column, b: Column, n: int = 2) -> Column:
    """Of the n-gram sets a and b of texts x and y: 1 if both texts are empty, 0 if one is, equality if either is shorter than n."""
    both = (x == "") & (y == "")
    one = (x == "") | (y == "")
    return (
        F.when(both, 1.0).when(one, 0.0)
        .when((F.length(x) < n) | (F.length(y) < n), (x == y).cast("double"))
        .otherwise(2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))
    )
