"""Boolean logic over values that may be undefined (SQL ``NULL``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def is_true(predicate: Column) -> Column:
    """Undefined counts as false."""
    return F.coalesce(predicate, F.lit(False))


def op_and(*predicates: Column) -> Column:
    return reduce(lambda a, b: a & b, [is_true(p) for p in predicates])


def op_or(*predicates: Column) -> Column:
    return reduce(lambda a, b: a | b, [is_true(p) for p in predicates])


def op_not(predicate: Column) -> Column:
    """``not undefined`` is true, unlike SQL."""
    return ~is_true(predicate)


def is_member(value: Column, members, ci: bool = False) -> Column:
    """Membership in a list of literals or in an array column."""
    if isinstance(members, Column):
        if ci:
            return F.array_contains(F.transform(members, F.lower), F.lower(value))
        return F.array_contains(members, value)
    if ci:
        return F.lower(value).isin([m.lower() for m in members])
    return value.isin(list(members))


def equals(left: Column, right, ci: bool = False) -> Column:
    right = right if isinstance(right, Column) else F.lit(right)
    return F.lower(left) == F.lower(right) if ci else left == right


def differs(left: Column, right, ci: bool = False) -> Column:
    right = right if isinstance(right, Column) else F.lit(right)
    return F.lower(left) != F.lower(right) if ci else left != right
