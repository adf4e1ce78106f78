"""Scalar functions on times and numbers.  Bad input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_epoch(text: Column) -> Column:
    """Seconds since 1970 of ``yyyy-MM-dd HH:mm:ss`` (more than 10 characters) or ``yyyy-MM-dd``."""
    long = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    return F.when(F.length(text) > 10, F.unix_seconds(long)).otherwise(F.unix_seconds(day))


def from_epoch(seconds: Column) -> Column:
    return F.from_unixtime(seconds, "yyyy-MM-dd HH:mm:ss")


def truncate(number: Column) -> Column:
    """A number without its fraction; null where a long can't hold it."""
    return number.try_cast("bigint")


def present(value: Column) -> Column:
    """Whether a stored number counts as a value: not the largest long, and not -1."""
    low = F.lit((1 << 63) - 1)
    return value.bitwiseAND(low) != low


def bit_test(bits: Column, at: Column) -> Column:
    """Whether a bit, 0 to 63, of a long is set; null beyond."""
    return F.when(at.between(0, 63), F.call_function("shiftrightunsigned", bits, at.cast("int")).bitwiseAND(F.lit(1)) == 1)


def _bit(at: Column) -> Column:
    return F.when(at.between(0, 63), F.call_function("shiftleft", F.lit(1).cast("bigint"), at.cast("int")))


def bit_set(bits: Column, at: Column) -> Column:
    return bits.bitwiseOR(_bit(at))


def bit_clear(bits: Column, at: Column) -> Column:
    return bits.bitwiseAND(F.bitwise_not(_bit(at)))
