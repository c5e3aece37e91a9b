"""Rounding of doubles by their exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_decimal(x: Column) -> Column:
    """x to one decimal, a tie to the even digit, where only the exact binary value decides: 0.25 gives 0.2, and 0.35, which is a little less, 0.3.

    |x| is a whole number m over a power of two, 2 ** k, both exact in doubles; so ten times it, in whole numbers, is cut at bit k and the rest compared with a half. m has at most
    55 bits, so nothing leaves 64. Below 0.01 the result is 0 with x's sign, from 2 ** 52 on x is whole; null, NaN and infinities stay."""
    size = F.abs(x.cast("double"))
    k = (F.lit(53) - F.floor(F.log2(size))).cast("int")
    ten = (size * F.pow(F.lit(2.0), k)).cast("long") * 10
    cut = F.call_function("shiftright", ten, k)
    twice = (ten - F.call_function("shiftleft", cut, k)) * 2
    one = F.call_function("shiftleft", F.lit(1).cast("long"), k)
    up = F.when((twice > one) | ((twice == one) & (cut % 2 == 1)), 1).otherwise(0)
    signed = lambda v: F.when(x < 0, -v).otherwise(v)
    tenth = F.when(cut < 2**53, (cut + up) / F.lit(10.0)).otherwise(((cut + up).cast("decimal(19,0)") * F.lit("0.1").cast("decimal(2,1)")).cast("double"))
    return F.when(F.isnan(x) | (size >= 2.0**52), x).when(size < 0.01, signed(F.lit(0.0))).otherwise(signed(tenth))


def share(part: Column, whole: Column) -> Column:
    """Percent to one decimal; null when there is nothing to share."""
    return F.when(whole != 0, one_decimal(F.lit(100.0) * part / whole))
