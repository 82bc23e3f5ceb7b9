"""Text helpers that follow Unicode white space and line-break rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every separator that ends a line.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\f\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def blank(c: Column) -> Column:
    return strip(c) == ""


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)
