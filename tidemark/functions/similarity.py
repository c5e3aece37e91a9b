"""String similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_USED = "\0"


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro similarity with up to four common leading characters counted a tenth each, from a similarity of 0.7 on.

    Two empty strings are alike (1.0), one empty string is like nothing (0.0). Texts with a NUL character aren't supported.
    """
    la, lb = F.length(a), F.length(b)
    reach = F.greatest(F.floor(F.greatest(la, lb) / 2).cast("int") - 1, F.lit(0))
    start = F.struct(b.alias("rest"), F.lit("").alias("mine"))

    def step(acc, i):
        c, low = F.substr(a, i, F.lit(1)), F.greatest(i - reach, F.lit(1))
        at = F.instr(F.substr(acc["rest"], low, i + reach - low + 1), c)
        rest = F.when(at > 0, F.overlay(acc["rest"], F.lit(_USED), low + at - 1, F.lit(1))).otherwise(acc["rest"])
        return F.struct(rest.alias("rest"), F.when(at > 0, F.concat(acc["mine"], c)).otherwise(acc["mine"]).alias("mine"))

    def score(acc):
        m = F.length(acc["mine"])
        theirs = F.filter(F.sequence(F.lit(1), lb), lambda k: F.substr(acc["rest"], k, F.lit(1)) == _USED)
        moved = F.size(F.filter(theirs, lambda k, i: F.substr(b, k, F.lit(1)) != F.substr(acc["mine"], i + 1, F.lit(1))))
        jaro = (m / la + m / lb + (m - F.floor(moved / 2)) / m) / 3.0
        same = F.lit(0)
        for k in range(4, 0, -1):
            same = F.when((la >= k) & (lb >= k) & (F.substr(a, F.lit(k), F.lit(1)) == F.substr(b, F.lit(k), F.lit(1))), same + 1).otherwise(F.lit(0))
        return F.when(m == 0, F.lit(0.0)).when(jaro > 0.7, jaro + same * 0.1 * (1 - jaro)).otherwise(jaro)

    whole = F.aggregate(F.sequence(F.lit(1), la), start, step, score)
    return F.when((la == 0) & (lb == 0), F.lit(1.0)).when((la == 0) | (lb == 0), F.lit(0.0)).otherwise(whole)
