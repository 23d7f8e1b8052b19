"""Doubles as whole numbers of the same order, cut into digits: columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_BITS, SECOND_BITS, LAST_BITS = 22, 21, 21


def order_code(value: str) -> Column:
    """64 bits which, read as an unsigned number, order as the doubles do; equal doubles (0.0 and -0.0 too) have equal bits, NaN is largest.
    NULL for NULL."""
    told = f"java_method('java.lang.Double', 'doubleToLongBits', `{value}` + 0.0D)"
    bits = F.expr(f"CAST(CASE WHEN `{value}` IS NOT NULL THEN {told} END AS BIGINT)")
    return F.transform(F.array(bits), lambda b: F.when(b < 0, F.bitwise_not(b)).otherwise(b.bitwiseXOR(F.lit(-(1 << 63)))))[0]


def with_digits(df: DataFrame, value: str, first: str = "d1", second: str = "d2") -> DataFrame:
    """Add the leading 22 and the next 21 bits of the value's code. Values that share both differ in 21 bits only, so at most 2^21 distinct ones do."""
    coded = df.withColumn("__code", order_code(value))
    inner = F.shiftrightunsigned("__code", LAST_BITS).bitwiseAND(F.lit((1 << SECOND_BITS) - 1))
    return coded.withColumns({first: F.shiftrightunsigned("__code", SECOND_BITS + LAST_BITS).cast("int"), second: inner.cast("int")}).drop("__code")
