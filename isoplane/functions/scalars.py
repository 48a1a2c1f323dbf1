"""Null-safe scalar helpers shared by the operators."""

import functools
import operator

from pyspark.sql import Column, functions as F

from isoplane.spec import BAND_WIDTH


def quotient(a: Column, b: Column) -> Column:
    """Division giving NULL for a zero divisor."""
    return F.try_divide(a, b)


def defined(value: Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(value), value)


def clip(value: Column, lo=None, hi=None) -> Column:
    """Limit to a range; NULL stays NULL."""
    bounded = value if hi is None else F.least(value, F.lit(hi))
    bounded = bounded if lo is None else F.greatest(bounded, F.lit(lo))
    return F.when(value.isNotNull(), bounded)


def rounded(value: Column, digits: int) -> Column:
    """Rounded half away from zero in floating point, without negative zero.

    Stays in generated code; the built-in goes through decimals. A value that has no
    digit left to round at that place is returned as it is.
    """
    unit = F.lit(10.0 ** digits)
    near = F.signum(value) * F.floor(F.abs(value) * unit + 0.5) / unit + F.lit(0.0)
    return F.when(F.abs(value) * unit < 2.0 ** 53, near).otherwise(value)


def all_of(conditions) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))


def band(mean: Column, std: Column) -> tuple[Column, Column]:
    """95 % limits around a predicted mean."""
    return mean - BAND_WIDTH * std, mean + BAND_WIDTH * std


def keyed_hash(columns, seed: int) -> Column:
    """A number below 2^60 for the written values and a seed; other engines get the same from MD5."""
    written = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(written), 1, 15), 16, 10).cast("long")
