"""Scalars: identities of reductions, IEEE division, NaN rules and conversions.

All are compositions of built-in functions, so they stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompilationError

KINDS = ("sum", "max", "min")
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def is_element_type(kind: T.DataType) -> bool:
    """Segments hold integers, booleans (one bit) or floats."""
    return isinstance(kind, (T.BooleanType, T.FloatType, T.DoubleType, *_BITS))


def identity(reduction: str, kind: T.DataType) -> Column:
    """What a reduction of an empty segment gives: 0, the least or the greatest value of the type."""
    if reduction not in KINDS:
        raise CompilationError(f"unknown reduction kind {reduction!r}; expected one of {', '.join(KINDS)}")
    if reduction == "sum":
        return F.lit(0).cast(kind)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.lit(float("-inf") if reduction == "max" else float("inf")).cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(reduction == "min")
    bits = _BITS[type(kind)]
    return F.lit(-(1 << bits - 1) if reduction == "max" else (1 << bits - 1) - 1).cast(kind)


def nan_max(x: Column) -> Column:
    """Aggregate maximum; NaN wins, as NaN sorts greatest."""
    return F.max(x)


def nan_min(x: Column) -> Column:
    """Aggregate minimum of floats in which NaN wins, unlike in the built-in one."""
    return F.when(F.max(F.isnan(x)), F.lit(float("nan"))).otherwise(F.min(x))


def ieee_divide(n: Column, d: Column) -> Column:
    """Division of floats that gives infinities and NaN where ANSI mode would raise."""
    n, d = n.cast("double"), d.cast("double")
    at_zero = F.when(F.isnan(n) | (n == 0), F.lit(float("nan"))).when(n > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(d == 0, at_zero).otherwise(n / F.when(d == 0, F.lit(1.0)).otherwise(d))


def to_int(x: Column) -> Column:
    """Float to 32-bit integer, towards zero; out of range raises."""
    return x.cast("int")


def float32(x: Column) -> Column:
    """Single precision; narrower floats have no Spark type and are kept as this one."""
    return x.cast("float")


