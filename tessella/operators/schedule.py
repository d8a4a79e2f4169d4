"""Schedules: packing, length classes, split and merge, and mixed policies.

None changes a result; they change how work is dealt to tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CompilationError
from ..functions.scalar import KINDS, identity
from ..plans.segments import Segments

TILE = 128


def pack(bounds: DataFrame, tile: int = TILE) -> DataFrame:
    """(sid, lo, hi, task): neighbouring short segments share a task of about ``tile`` elements."""
    return bounds.withColumn("task", F.floor(F.col("lo") / tile).cast("bigint"))


def length_class(extent: Column, short: int = 32, medium: int = 1024) -> Column:
    return F.when(extent == 0, "empty").when(extent <= short, "short").when(extent <= medium, "medium").otherwise("long")


def split_merge(segments: Segments, kind: str, salt: Column, parts: int = 8, name: str = "out") -> DataFrame:
    """A reduction in two steps, parts of a segment first; ``salt`` is any integer of the element's row.

    Reductions are associative and commutative, so a hot segment can be split: its
    parts are reduced in different tasks and only their results meet.
    """
    return _in_parts(segments, kind, F.pmod(salt, F.lit(parts)), name)


def _in_parts(segments: Segments, kind: str, part: Column, name: str) -> DataFrame:
    if kind not in KINDS:
        raise CompilationError(f"unknown reduction kind {kind!r}; expected one of {', '.join(KINDS)}")
    salted = segments.elements.withColumn("part", part)
    make = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
    partial = salted.groupBy("sid", "part").agg(make("v").alias("p"), F.max(F.isnan(F.col("v").cast("double"))).alias("nan"))
    merged = partial.groupBy("sid").agg(make("p").alias("p"), F.max("nan").alias("nan"))
    if kind == "min" and segments.kind.typeName() in ("float", "double"):
        merged = merged.withColumn("p", F.when(F.col("nan"), F.lit(float("nan"))).otherwise(F.col("p")))
    found = merged.select("sid", F.col("p").alias(name))
    return segments.domain.join(found, "sid", "left").select("sid", F.coalesce(F.col(name), identity(kind, found.schema[name].dataType)).alias(name))


def mixed(segments: Segments, kind: str, salt: Column, limit: int = 1024, parts: int = 8, name: str = "out") -> DataFrame:
    """Long segments are split and merged, the others reduced in one part, in one pass over the elements.

    The segments of more than ``limit`` elements, of which there are at most elements /
    ``limit``, are sent to all tasks.
    """
    long = segments.elements.groupBy("sid").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("sid", F.lit(True).alias("long"))
    marked = segments.elements.join(F.broadcast(long), "sid", "left")
    return _in_parts(Segments(segments.domain, marked), kind, F.when(F.col("long"), F.pmod(salt, F.lit(parts))).otherwise(0), name)
