"""Column helpers with the engine's conventions: null means "does not apply"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero: equal across engines that add in another order."""
    return F.round(c, digits) + F.lit(0.0)


def no_nan(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def miss_probability(n: Column, bad: Column, k: Column) -> Column:
    """Chance that k rows (n at most) drawn without replacement from n hold none of the bad ones (hypergeometric)."""
    step = lambda acc, i: acc * F.greatest(n - bad - i, F.lit(0)).cast("double") / (n - i)
    k = F.least(k.cast("bigint"), n.cast("bigint"))
    return F.when(k <= 0, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(0).cast("bigint"), k - 1), F.lit(1.0), step))


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) that the parts alone decide, the same on every engine with MD5."""
    text = F.concat_ws("/", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)
