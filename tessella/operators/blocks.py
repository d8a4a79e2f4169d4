"""Programs over fixed blocks: program id, lanes, masks, masked loads and stores.

Rows carry pos; program id and lane are projections of it, a mask is a condition
on it, so a whole program is one projection and, for a store, one filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CompilationError


def validate_launch(n: int, count: int, block: int, grid: int) -> None:
    """Bounds and grid of a launch over ``count`` elements, of which the first ``n`` are used."""
    if isinstance(block, bool) or not isinstance(block, int) or block <= 0:
        raise CompilationError("BLOCK must be a positive int")
    if not 0 <= n <= count or n >= 1 << 31:
        raise CompilationError(f"n must be between 0 and the element count {count} and fit in 32 bits")
    if grid != -(-n // block):
        raise CompilationError(f"grid must be {-(-n // block)} for n={n} and BLOCK={block}, not {grid}")


def program_id(pos: Column, block: int) -> Column:
    return F.floor(pos / F.lit(block)).cast("bigint")


def lane(pos: Column, block: int) -> Column:
    return (pos % F.lit(block)).cast("bigint")


def bounds_mask(pos: Column, n: int | Column) -> Column:
    """The mask of lanes inside the first ``n`` elements; masks combine with & and |."""
    return pos < n


def grid(spark: SparkSession, n: int, block: int) -> DataFrame:
    """(pos, pid, lane, active): every lane of every program over n elements."""
    rows = spark.range(-(-n // block) * block).select(F.col("id").alias("pos"))
    return rows.select("pos", program_id(F.col("pos"), block).alias("pid"), lane(F.col("pos"), block).alias("lane"), bounds_mask(F.col("pos"), n).alias("active"))


def load(lanes: DataFrame, data: DataFrame, value: str, mask: Column, other: float = 0.0, name: str = "x") -> DataFrame:
    """Masked load: ``value`` of ``data`` (pos, value) at each lane's pos, ``other`` where ``mask``, a condition on the lanes, is off."""
    kind = data.schema[value].dataType
    asked = lanes.withColumn("__on", F.coalesce(mask, F.lit(False)))
    found = asked.join(data.select("pos", F.col(value).alias(name)), "pos", "left")
    return found.withColumn(name, F.when(F.col("__on"), F.col(name)).otherwise(F.lit(other).cast(kind))).drop("__on")


def store(lanes: DataFrame, value: Column, mask: Column, name: str = "out") -> DataFrame:
    """Masked store: (pos, out) of the lanes whose mask is on."""
    return lanes.where(mask).select("pos", value.alias(name))


def vector_add(data: DataFrame, x: str, y: str, n: int) -> DataFrame:
    """(pos, out): x + y of the first n elements, in single precision."""
    return store(data, F.col(x).cast("float") + F.col(y).cast("float"), bounds_mask(F.col("pos"), n))
