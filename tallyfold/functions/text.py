"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lookup(table: dict, key: Column) -> Column:
    """A value of a small fixed table, null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def group_of(text: Column, pattern: str, group: int) -> Column:
    """A group of a pattern's first match, null if there is no match or the group took no part."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once. Large bodies are so kept out of generated code, whose size is limited."""
    return F.element_at(F.transform(F.array(value), body), 1)
