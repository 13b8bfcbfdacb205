"""Guarded arithmetic and parsing. Missing is NULL everywhere; NaN never leaves these functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number once commas are gone, as group 1.
NUMBER_SHAPE = r"(?U)^\s*([+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?))\s*$"
OUTER_SPACE = r"(?U)^\s+|\s+$"


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def clean(x: Column) -> Column:
    """x; NULL where it is NaN."""
    return F.when(~F.isnan(x), x)


def trimmed(text: Column) -> Column:
    """text without outer white space of any kind."""
    return F.regexp_replace(text, OUTER_SPACE, "")


def parse_number(text: Column) -> Column:
    """The double that text states, with thousands commas and outer white space allowed; NULL where it states none."""
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), NUMBER_SHAPE, 1).try_cast("double")
