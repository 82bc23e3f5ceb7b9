"""Numeric column helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_mean(c: Column, digits: int = 2) -> Column:
    """Rounded mean of a column of rounded doubles.

    Summing as DECIMAL makes the result independent of the order in which
    partitions arrive, so reruns and retries give the same digits.
    """
    return F.round(F.avg(c.cast("decimal(18,4)")), digits).cast("double")


def percent(part: Column, total: Column, digits: int = 1) -> Column:
    """Share in percent; NULL when the total is zero."""
    return F.round(part / F.nullif(total, F.lit(0)) * 100, digits)


def fixed_2(c: Column) -> Column:
    """Text with two decimals for values in [0, 8), rounding the exact binary value.

    ``format_string('%.2f')`` rounds the shortest decimal text half up, which
    turns 0.825 into 0.83 although the stored double lies below 0.825. Scaling
    by 2**60 is exact for every double that can lie near a tie.
    """
    one = F.lit(2**60).cast("decimal(20,0)")
    half = F.lit(2**59).cast("decimal(20,0)")
    scaled = (c * F.lit(float(2**60))).cast("bigint").cast("decimal(20,0)") * F.lit(100)
    whole = F.floor(scaled / one)
    # decimal division is rounded, so step back when it reached the next integer
    whole = F.when(whole * one > scaled, whole - 1).otherwise(whole)
    rest = scaled - whole * one
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    cents = (whole + F.when(up, 1).otherwise(0)).cast("bigint")
    return F.concat(
        F.floor(cents / 100).cast("string"),
        F.lit("."),
        F.lpad((cents % 100).cast("string"), 2, "0"),
    )
