"""Array form: a segment is one array cell, so nothing is shuffled and order is kept.

For short segments and where the sequential order of a sum matters; long or skewed
segments belong in rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CompilationError
from ..functions.scalar import KINDS, identity


def slice_of(values: Column, lo: Column, hi: Column) -> Column:
    """values[lo:hi) of an array."""
    return F.slice(values, lo + 1, hi - lo)


def fold(kind: str, values: Column, element: str = "double") -> Column:
    """Sequential left-to-right reduction of an array in the precision of ``element``."""
    from pyspark.sql.types import _parse_datatype_string

    if kind not in KINDS:
        raise CompilationError(f"unknown reduction kind {kind!r}; expected one of {', '.join(KINDS)}")
    start = identity(kind, _parse_datatype_string(element))
    typed = F.transform(values, lambda x: x.cast(element))
    if kind == "sum":
        return F.aggregate(typed, start, lambda a, x: a + x)
    if kind == "max":
        return F.coalesce(F.array_max(typed), start)
    low = F.coalesce(F.array_min(typed), start)
    if element not in ("float", "double"):
        return low
    return F.when(F.exists(typed, lambda x: F.isnan(x)), F.lit(float("nan")).cast(element)).otherwise(low)


def softmax(rows: DataFrame, sid: str, values: str, name: str = "out") -> DataFrame:
    """(sid, pos, out) of a stable softmax inside each array."""
    x = F.transform(values, lambda v: v.cast("double"))
    top = rows.select(F.col(sid).alias("sid"), x.alias("x"), F.array_max(x).alias("m"))
    e = top.select("sid", F.transform("x", lambda v: F.exp(v - F.col("m"))).alias("e"))
    whole = e.select("sid", "e", F.aggregate("e", F.lit(0.0), lambda a, v: a + v).alias("d"))
    parts = whole.select("sid", "d", F.posexplode("e").alias("pos", "e"))
    return parts.select("sid", F.col("pos").cast("bigint").alias("pos"), (F.col("e") / F.col("d")).alias(name))


def zip_with(a: Column, b: Column, region: Callable[[Column, Column], Column]) -> Column:
    """A region over two arrays; unequal lengths raise."""
    same = F.size(a) == F.size(b)
    return F.when(same, F.zip_with(a, b, region)).otherwise(F.raise_error(F.lit("zipped segments must have equal extents")))
