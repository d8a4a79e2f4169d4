"""Helpers that the operators of this subpackage share.

Everything here is deterministic: a task that is run again after an executor
was lost gives the same rows.  Intermediate tables go to the folder named by
``spark.checkpoint.dir`` (shared by driver and executors); nothing is kept in
executors' own folders but Spark's shuffle files.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a text that count as white space: [\x20\x09-\x0D].
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tessella-")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; one of its own only in a single local JVM (tests) where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{_own_dir()}"


def _files(spark: SparkSession, path: str):
    """Path and file system of a folder, as Spark sees them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts the lineage.

    The table is deleted when the driver ends, or before by :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    where, files = _files(spark, path)
    files.deleteOnExit(where)
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the tables written inside are deleted when these are complete, not at the driver's leisure."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def bucketed(df: DataFrame, key: str, buckets: int, tag: str) -> DataFrame:
    """Like :func:`materialise`, dealt by ``key``, so that joining or grouping by it moves nothing."""
    spark = df.sparkSession
    name = f"tessella_{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    where, files = _files(spark, path)
    files.deleteOnExit(where)
    with _shuffles_dropped(spark):
        df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._written, out._buckets = path, buckets
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of :func:`materialise` that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_written", None):
            where, files = _files(df.sparkSession, path)
            files.delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (columns u, v): one row per node, (v, c), c the smallest node.

    Each round hooks every node that has a smaller neighbour to the smallest one,
    replaces parents by their own parents until all point to roots, and keeps
    only the links between different roots, of which there are at most half as
    many nodes.  All joins read written tables, so both sides are plain shuffles
    that adaptive execution can split at hot nodes.
    """
    low, high = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    left = materialise(edges.where("u <> v").select(low, high).distinct(), f"{tag}-links")
    found = None
    while not left.isEmpty():
        parents = materialise(left.groupBy("v").agg(F.min("u").alias("c")), f"{tag}-parents")
        while True:
            up = parents.select(F.col("v").alias("c"), F.col("c").alias("cc"))
            raised = materialise(parents.select("v", "c").join(up, "c", "left").select("v", F.coalesce("cc", "c").alias("c"), F.col("cc").isNotNull().alias("moved")), f"{tag}-roots")
            discard(parents)
            parents = raised
            if raised.where("moved").isEmpty():
                break
        roots = parents.select("v", "c")
        if found is None:
            merged = materialise(roots, f"{tag}-found")
        else:
            up = roots.select(F.col("v").alias("c"), F.col("c").alias("cc"))
            merged = materialise(found.join(up, "c", "left").select("v", F.coalesce("cc", "c").alias("c")).union(roots), f"{tag}-found")
        of_u, of_v = (roots.select(F.col("v").alias(x), F.col("c").alias(f"c{x}")) for x in "uv")
        ends = left.join(of_u, "u", "left").join(of_v, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
        links = materialise(ends.where("u <> v").select(low, high).distinct(), f"{tag}-links")
        discard(found, left, parents)
        found, left = merged, links
    if found is None:
        return left.select("v", F.col("u").alias("c"))
    out = materialise(found.union(found.select(F.col("c").alias("v"), "c").distinct()), f"{tag}-components")
    discard(found, left)
    return out


# --- Arrow and numpy -------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct entries and how often each occurs, by one sort."""
    x = np.sort(x)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each, or of one longer row."""
    out, start = [], 0
    while start < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), len(offsets) - 1)
        out.append((start, end))
        start = end
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), in place."""
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends (positions in ``data``) and, per text, the first word's number (n + 1)."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    part = data[lo:hi]
    if not len(part):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = IS_SPACE[part]
    edge = np.empty(len(part) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = space[:-1]
    cuts = offsets[1:-1] - lo
    edge[cuts] = True
    starts = np.flatnonzero(edge[:-1] & ~space)
    edge[1:-1] = space[1:]
    edge[cuts] = True
    ends = np.flatnonzero(edge[1:] & ~space) + 1
    return starts + lo, ends + lo, np.searchsorted(starts, offsets - lo)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word's bytes (FNV-1a, finalised); ``lower`` folds A-Z."""
    if lower:
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        data = fold[data]
    h = np.full(len(starts), 0xCBF29CE484222325, dtype=np.uint64)
    at, length, left = starts, ends - starts, None
    j = 0
    while len(at):
        if left is None:
            h ^= data[at]
            h *= U64(0x100000001B3)
        else:
            x = h[left] ^ data[at + j]
            h[left] = x * U64(0x100000001B3)
        j += 1
        keep = length > j
        if left is None:
            left = np.flatnonzero(keep)
        else:
            left = left[keep]
        at, length = at[keep], length[keep]
    return mix(h)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries of ``h``; the last k - 1 are missing."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= U64(0x9E3779B97F4A7C15)
        g += h[j : j + n]
    return mix(g)
