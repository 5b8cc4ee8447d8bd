"""Keys of entities and attributes: sets of normalised words."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Phrases and their acronyms, rewritten in this order.
ACRONYMS = [
    ("gross domestic product", "gdp"),
    ("gross value added", "gva"),
    ("consumer price index", "cpi"),
    ("wholesale price index", "wpi"),
    ("current account deficit", "cad"),
    ("current account balance", "cab"),
    ("foreign direct investment", "fdi"),
    ("foreign portfolio investment", "fpi"),
    ("external commercial borrowing", "ecb"),
    ("non performing asset", "npa"),
    ("capital expenditure", "capex"),
    ("earnings per share", "eps"),
    ("profit after tax", "pat"),
    ("earnings before interest tax depreciation and amortisation", "ebitda"),
    ("earnings before interest tax depreciation and amortization", "ebitda"),
    ("year on year", "yoy"),
    ("y o y", "yoy"),
    ("quarter on quarter", "qoq"),
    ("q o q", "qoq"),
]
# Words that keys leave out.
STOP_WORDS = ["the", "of", "in", "for", "and", "a", "an", "to", "on", "at", "by", "from", "as", "per", "or"]


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(text: Column) -> Column:
    """NFKC form. Spark has no such function; texts of ASCII characters alone are their own and do not leave the JVM."""
    return F.coalesce(nfkc(F.when(text.rlike("[^\\x00-\\x7F]"), text)), text)


def singular(word: Column) -> Column:
    plural = (F.length(word) > 3) & word.endswith("s") & ~word.rlike("(?:ss|is|us)$")
    return F.when(plural, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def canonical_key(text: Column) -> Column:
    """The distinct words of a name in order: no case, brackets, punctuation, stop words or plurals.

    Well-known phrases become acronyms. A null or empty name has the empty key.
    """
    t = F.lower(compatible(F.coalesce(text, F.lit(""))))
    t = F.regexp_replace(t, r"\([^)]*\)|\[[^\]]*\]", " ")
    t = F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))
    for phrase, acronym in ACRONYMS:
        t = F.regexp_replace(t, rf"\b{phrase}\b", acronym)
    words = F.filter(F.split(t, " +"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(words, singular))), " ")


def tokens(key: Column) -> Column:
    """The words of a key; the empty key has none."""
    return F.filter(F.split(key, " "), lambda w: w != "")


def entities_match(a: Column, b: Column) -> Column:
    """Whether one set of words contains the other; an empty one is contained in any."""
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def fact_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)
