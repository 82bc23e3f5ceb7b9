"""Casts that give NULL instead of failing."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_double(c: Column) -> Column:
    return c.try_cast("double")


def safe_int(c: Column) -> Column:
    """Integer part of a number given as text."""
    return c.try_cast("double").try_cast("int")


def safe_boolean(c: Column) -> Column:
    """Only "true" and "1" are true; NULL stays NULL."""
    return F.lower(c.cast("string")).isin("true", "1")
