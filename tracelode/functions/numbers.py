"""Arithmetic in which bad operands give ``NULL`` instead of an error."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def to_number(text: Column) -> Column:
    return text.try_cast("double")


def add(a: Column, b) -> Column:
    return F.try_add(a, b if isinstance(b, Column) else F.lit(b))


def subtract(a: Column, b) -> Column:
    return F.try_subtract(a, b if isinstance(b, Column) else F.lit(b))


def multiply(a: Column, b) -> Column:
    return F.try_multiply(a, b if isinstance(b, Column) else F.lit(b))


def divide(a: Column, b) -> Column:
    return F.try_divide(a, b if isinstance(b, Column) else F.lit(b))


def remainder(a: Column, b) -> Column:
    return F.try_mod(a, b if isinstance(b, Column) else F.lit(b))


def power(a: Column, b) -> Column:
    return F.pow(a, b if isinstance(b, Column) else F.lit(b))


def negate(a: Column) -> Column:
    return F.negative(a)


def round_to(value: Column, places: int = 0) -> Column:
    """Midpoints go up, towards positive infinity."""
    factor = float(10 ** places)
    return F.floor(value * factor + 0.5) / factor


def bucket(value: Column, err: float = 0.01) -> Column:
    """Midpoint of the logarithmic bucket around ``value``; buckets grow by (1+err)/(1-err)."""
    if not 0 < err < 1:
        raise ValueError("err must lie between 0 and 1")
    gamma = (1 + err) / (1 - err)
    size = F.abs(value)
    index = F.ceil(F.log(size) / math.log(gamma))
    middle = (F.pow(F.lit(gamma), index - 1) + F.pow(F.lit(gamma), index)) / 2
    return F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * middle)


BANDS_PER_OCTAVE = 4096


def magnitude_band(value: Column) -> Column:
    """A coarse, order-preserving band number for a double: 4096 bands per power of two.

    Equal bands can be compared or counted without looking at single values, so a large group
    is narrowed to one band before anything in it is sorted.
    """
    # Doubles reach down to 2^-1074, so the shifted number is positive for all of them.
    band = F.floor(F.log2(F.abs(value)) * BANDS_PER_OCTAVE) + 1100 * BANDS_PER_OCTAVE
    return (F.when(value == 0, F.lit(0)).when(value > 0, band).otherwise(-band)).cast("bigint")
