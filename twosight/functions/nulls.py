"""Missing-value and numeric rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict(agg: Column, value: Column | str) -> Column:
    """An aggregate that is NULL as soon as one value of the group is missing."""
    return F.when(F.count(col(value)) == F.count(F.lit(1)), agg)


def if_known(test: Column, yes, no) -> Column:
    """NULL when the test is NULL, unlike ``when().otherwise()``."""
    return F.when(test, yes).when(~test, no)


def matches(value: Column | str, pattern: str) -> Column:
    """Regex test that is false, not NULL, for a missing value."""
    return F.coalesce(col(value).rlike(pattern), F.lit(False))


def is_in(value: Column | str, members: list) -> Column:
    """Membership that is false, not NULL, for a missing value."""
    return F.coalesce(col(value).isin(members), F.lit(False))


def flag(test: Column) -> Column:
    """1/0 for true/false, NULL for unknown."""
    return test.cast("int")


def ratio(a: Column | str, b: Column | str) -> Column:
    """Division giving NULL for a zero or missing denominator."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def round_even(value: Column | str, digits: int = 0) -> Column:
    return F.bround(col(value), digits)


def row_min(*values: Column | str) -> Column:
    """Element-wise minimum; NULL if any argument is NULL (``least`` alone would skip it)."""
    cols = [col(v) for v in values]
    known = cols[0].isNotNull()
    for c in cols[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.least(*cols))


def bin_floor(value: Column | str, per_unit: int, cap: float | None = None) -> Column:
    """Lower edge of bins of width 1/per_unit; ``cap`` closes the last bin (0.99 puts 1.0 in it)."""
    v = col(value) if cap is None else row_min(value, F.lit(cap))
    return F.floor(v * per_unit) / F.lit(float(per_unit))


def decile(value: Column | str) -> Column:
    return bin_floor(value, 10, cap=0.99)


def fraction(text: Column | str) -> Column:
    """``"7/14"`` -> 0.5; NULL for missing, malformed or zero-denominator text."""
    t = col(text)
    top = F.split_part(t, F.lit("/"), F.lit(1)).try_cast("double")
    bottom = F.split_part(t, F.lit("/"), F.lit(2)).try_cast("double")
    return F.try_divide(top, bottom)


def std_error(value: Column | str) -> Column:
    """Aggregate sd/sqrt(rows); rows with a missing value count as rows."""
    return F.stddev_samp(col(value)) / F.sqrt(F.count(F.lit(1)).cast("double"))


def binomial_se(p: Column | str, n: Column | str) -> Column:
    return F.sqrt(col(p) * (1 - col(p)) / col(n))


def share_of(test: Column) -> Column:
    """Aggregate share of rows where ``test`` holds (rows where it is unknown do not count)."""
    return F.avg(flag(test))


def count_if(test: Column) -> Column:
    return F.count(F.when(test, F.lit(1)))


def distinct_values(value: Column | str) -> Column:
    """Number of distinct values, a missing value counting as one of them."""
    c = col(value)
    return F.countDistinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))


def char_length(value: Column | str) -> Column:
    return F.char_length(col(value))
