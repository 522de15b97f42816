"""Small statistical expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


LIMB_BITS = 28


def steady_sum(value: Column | str) -> Column:
    """Sum of floats that does not depend on the order or the grouping of the rows.

    A number is cut into its floor and two limbs of 28 bits behind the point. These are whole numbers, whose sums are exact
    in any order, and they are put together once at the end; parts below 2^-56 of one row are not counted. A group with NaN
    or with a number of 2^62 or more in size has the plain sum instead.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    step = float(1 << LIMB_BITS)
    whole = F.floor(x)
    first = (x - whole) * step
    second = (first - F.floor(first)) * step
    fits = F.abs(x) < float(1 << 62)
    high = F.sum(F.when(fits, whole).cast("decimal(20,0)"))
    limbs = [F.sum(F.when(fits, F.floor(part)).cast("bigint")).cast("double") for part in (first, second)]
    total = high.cast("double") + (limbs[0] / step + limbs[1] / (step * step))
    return F.when(F.count_if(~fits) > 0, F.sum(x)).otherwise(total)


def steady_avg(value: Column | str) -> Column:
    return steady_sum(value) / F.count(value)


def steady_std(value: Column | str) -> Column:
    """Sample deviation from steady sums of the values and their squares; NULL for one row."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    n, total = F.count(x), steady_sum(x)
    return F.when(n > 1, F.sqrt(F.greatest((steady_sum(x * x) - total * total / n) / (n - 1), F.lit(0.0))))


def steady_error95(value: Column | str, n: Column | None = None) -> Column:
    """As ``error95``, whatever the order of the rows."""
    return steady_std(value) * 1.96 / F.sqrt(F.count(value) if n is None else n)


def error95(value: Column | str, n: Column | None = None) -> Column:
    """Half width of the 95 % interval of a mean (sample deviation); NULL for one row."""
    n = F.count(value) if n is None else n
    return F.stddev_samp(value) * 1.96 / F.sqrt(n)


def log2_ratio(share: Column, base: Column) -> Column:
    """Enrichment; NULL where the base is zero or the share is."""
    return F.log2(F.try_divide(share, base))


@F.pandas_udf(T.DoubleType())
def upper_tail(z: pd.Series) -> pd.Series:
    """P(Z > z) of the standard normal; used on one row per test."""
    return z.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(v / math.sqrt(2.0)))
