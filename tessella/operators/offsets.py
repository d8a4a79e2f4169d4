"""Offsets: prefix sums of extents, and the rules that bounds of segments must keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import CompilationError

BUCKETS = 256
MOST = (1 << 31) - 1


def _bucket(x: Column, cuts: Sequence[int], first: int = 0) -> Column:
    """Number of the range between sorted ``cuts`` that holds ``x``, by binary search in generated code."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    return F.when(x <= cuts[middle], _bucket(x, cuts[:middle], first)).otherwise(_bucket(x, cuts[middle + 1 :], first + middle + 1))


def dealt(rows: DataFrame, key: str = "sid", buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with a bucket: ranges of ``key`` in order, of about equal numbers of rows however the keys lie."""
    shares = [(i + 1) / buckets for i in range(buckets - 1)]
    found = rows.agg(F.percentile_approx(key, shares, 10 * buckets)).first()[0] if shares else None
    return rows.withColumn("bucket", _bucket(F.col(key), sorted(set(found or ()))))


def offsets(extents: DataFrame, extent: str = "extent", buckets: int = BUCKETS) -> DataFrame:
    """(sid, lo, hi): bounds of segments laid one after the other in order of an integer sid.

    Sums run inside ranges of sid that hold about as many segments each; only one row
    for each of at most ``buckets`` ranges meets in one task.
    """
    ranged = dealt(extents, "sid", buckets)
    whole = ranged.groupBy("bucket").agg(F.sum(extent).alias("n"))
    running = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    starts = whole.select("bucket", (running - F.col("n")).alias("start"))
    inside = F.sum(extent).over(Window.partitionBy("bucket").orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    ends = ranged.withColumn("end", inside).join(F.broadcast(starts), "bucket")  # at most ``buckets`` rows
    return ends.select("sid", (F.col("start") + F.col("end") - F.col(extent)).cast("bigint").alias("lo"), (F.col("start") + F.col("end")).cast("bigint").alias("hi"))


#: What a row of bounds breaks; ``before`` is the end of the segment before it (0 for the first one).
RULES = {
    "negative": "lo < 0 OR hi < 0",
    "backward": "hi < lo",
    "beyond": "hi > values",
    "late_start": "first AND lo <> 0",
    "gap": "NOT first AND lo > before",
    "overlap": "NOT first AND lo < before",
    "wide": f"abs(lo) > {MOST} OR abs(hi) > {MOST}",
}


def violations(bounds: DataFrame, value_count: int, buckets: int = BUCKETS) -> DataFrame:
    """One row: the number of segments in ``bounds`` (sid, lo, hi), and of those that break each of ``RULES``.

    Segments follow each other in order of sid.  The end of the one before comes from
    the same range of sids, or for the first of a range from the last of an earlier one,
    of which there are at most ``buckets``.
    """
    ranged = dealt(bounds, "sid", buckets)
    order = Window.partitionBy("bucket").orderBy("sid")
    lasts = ranged.groupBy("bucket").agg(F.max_by("hi", "sid").alias("last")).select("bucket", F.lag("last").over(Window.orderBy("bucket")).alias("carried"))
    rows = ranged.withColumn("own", F.lag("hi").over(order)).join(F.broadcast(lasts), "bucket")  # at most ``buckets`` rows
    before = F.coalesce("own", "carried")
    rows = rows.select("lo", "hi", F.coalesce(before, F.lit(0)).alias("before"), before.isNull().alias("first"), F.lit(value_count).alias("values"))
    return rows.agg(F.count("*").alias("segments"), *(F.count_if(F.expr(rule)).alias(name) for name, rule in RULES.items()))


def require(bounds: DataFrame, value_count: int, outputs: int | None = None) -> None:
    """Raises :class:`CompilationError` that names every rule ``bounds`` break and how often; ``outputs`` rows must take the results."""
    broken = [f"{name} ({size})" for name, size in (("values", value_count), ("outputs", outputs)) if size is not None and not 0 <= size <= MOST]
    if broken:
        raise CompilationError(f"sizes outside 0..2^31-1: {', '.join(broken)}")
    found = violations(bounds, value_count).first().asDict()
    segments = found.pop("segments")
    broken = [f"{name}: {n}" for name, n in found.items() if n]
    if outputs is not None and segments > outputs:
        broken.append(f"{segments} segments for {outputs} outputs")
    if broken:
        raise CompilationError(f"bounds break rules: {'; '.join(broken)}")


def bounds_of(spark: SparkSession, values: Sequence[int]) -> DataFrame:
    """(sid, lo, hi) of a list of offsets, which has an entry more than there are segments."""
    if not values:
        raise CompilationError("a list of offsets has at least one entry")
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(values, values[1:]))], "sid bigint, lo bigint, hi bigint")
