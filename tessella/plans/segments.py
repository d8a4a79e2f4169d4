"""Segments: variable-length slices of a column of values.

A ``Segments`` has a domain, one row for each segment, and elements, one row for
each value with the key of its segment.  The domain is carried through every
operator, so empty segments survive.  Positions exist only if asked for, by a
total order inside the segment, and captured scalars are window aggregates over
the key; all aggregates of one key share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CompilationError
from ..functions.scalar import KINDS, identity, is_element_type, nan_max, nan_min
from .region import Region, region_type


#: Positions of a segment that are spelled out in one row.
CHUNK = 4096
#: Elements from which a segment's captures are reduced in parts, where asked for.
HOT = 1 << 20


def _same(x: Column) -> Column:
    return x


class Segments:
    """domain: (sid); elements: (sid, v) with pos if ordered, and captured scalars."""

    def __init__(self, domain: DataFrame, elements: DataFrame, captured: Sequence[str] = (), hot: int | None = None) -> None:
        kind = elements.schema["v"].dataType
        if not is_element_type(kind):
            raise CompilationError(f"element type must be an integer or float, not {kind.simpleString()}")
        self.domain, self.elements, self.captured, self.kind = domain, elements, tuple(captured), kind
        self.hot = hot

    # -- construction

    @classmethod
    def from_keys(cls, domain: DataFrame, elements: DataFrame, sid: str, key: str, value: Column | str, order: Sequence[str] = ()) -> Segments:
        """Segments are the values of each ``key``; ``sid`` names the domain's key, unique there.

        ``order`` must be a total order inside a segment; it gives pos.  Values without a
        segment in the domain belong to none; a null value raises when it is read.
        """
        value = F.col(value) if isinstance(value, str) else value
        kind = elements.select(value.alias("v")).schema["v"].dataType
        if not is_element_type(kind):
            raise CompilationError(f"element type must be an integer or float, not {kind.simpleString()}")
        v = F.coalesce(value, F.raise_error(F.lit("segment values must not be null")).cast(kind)).alias("v")
        keys = [F.col(c).alias(f"__order{i}") for i, c in enumerate(order)]
        out = elements.where(F.col(key).isNotNull()).select(F.col(key).alias("sid"), v, *keys)
        if order:  # by the name that captures use, so that they share the shuffle
            place = F.row_number().over(Window.partitionBy("sid").orderBy(*(f"__order{i}" for i in range(len(keys)))))
            out = out.select("sid", "v", (place - 1).cast("bigint").alias("pos"))
        return cls(domain.select(F.col(sid).alias("sid")), out)

    @classmethod
    def from_csr(cls, values: DataFrame, offsets: DataFrame) -> Segments:
        """Segments are values[lo:hi) of ``values`` (pos, v) by the bounds of ``offsets`` (sid, lo, hi).

        Positions are spelled out and joined by equality, chunk by chunk, so that a hot
        segment is many rows and never one array; values that no bounds hold belong to
        no segment.
        """
        heads = F.when(F.col("hi") > F.col("lo"), F.sequence("lo", F.col("hi") - 1, F.lit(CHUNK)))
        chunks = offsets.select("sid", "lo", "hi", F.explode(heads).alias("head"))
        places = chunks.select("sid", "lo", F.explode(F.sequence("head", F.least(F.col("head") + CHUNK, "hi") - 1)).alias("at"))
        elements = places.join(values.select(F.col("pos").alias("at"), "v"), "at").select("sid", "v", (F.col("at") - F.col("lo")).alias("pos"), F.col("at").alias("at"))
        return cls(offsets.select("sid"), elements)

    @classmethod
    def from_arrays(cls, rows: DataFrame, sid: str, values: str) -> Segments:
        """Each row's array is a segment."""
        elements = rows.select(F.col(sid).alias("sid"), F.posexplode(values).alias("pos", "v"))
        return cls(rows.select(F.col(sid).alias("sid")), elements.withColumn("pos", F.col("pos").cast("bigint")))

    # -- operators

    def extent(self, name: str = "extent") -> DataFrame:
        """Number of elements of each segment, 0 for empty ones."""
        counts = self.elements.groupBy("sid").agg(F.count("*").alias(name))
        return self.domain.join(counts, "sid", "left").select("sid", F.coalesce(name, F.lit(0)).alias(name))

    def _checked(self, region: Region, captures: Sequence[str]):
        for name in captures:
            if name not in self.captured:
                raise CompilationError(f"unknown capture {name!r}; known: {', '.join(self.captured) or 'none'}")
        kinds = [(name, self.elements.schema[name].dataType) for name in captures]
        kind = region_type(self.elements.sparkSession, region, self.kind, kinds)
        return region(F.col("v"), *map(F.col, captures)), kind

    def map(self, region: Region, captures: Sequence[str] = ()) -> Segments:
        """Each element transformed; the type may change."""
        out, _ = self._checked(region, captures)
        return Segments(self.domain, self.elements.withColumn("v", out), self.captured, self.hot)

    def spread(self, hot: int = HOT) -> Segments:
        """The same segments; captures of those with over ``hot`` elements are reduced in parts, not in one task's window.

        Each capture then reads the elements twice.  Where no segment is that large the
        window's single pass is cheaper.
        """
        return Segments(self.domain, self.elements, self.captured, hot)

    def _aggregate(self, kind: str, region: Region, captures: Sequence[str]):
        if kind not in KINDS:
            raise CompilationError(f"unknown reduction kind {kind!r}; expected one of {', '.join(KINDS)}")
        x, type_ = self._checked(region, captures)
        floats = type_.typeName() in ("float", "double")
        # the min of floats must see NaN; the others do by themselves
        make = {"sum": F.sum, "max": nan_max, "min": nan_min if floats else F.min}[kind]
        return x, make, type_

    def reduce(self, kind: str, region: Region = _same, captures: Sequence[str] = (), name: str = "out") -> DataFrame:
        """Elements transformed and reduced by sum, max or min; an empty segment gives the identity."""
        x, make, _ = self._aggregate(kind, region, captures)
        found = self.elements.groupBy("sid").agg(make(x).alias(name))
        return self.domain.join(found, "sid", "left").select("sid", F.coalesce(F.col(name), identity(kind, found.schema[name].dataType)).alias(name))

    def capture(self, name: str, kind: str, region: Region = _same, captures: Sequence[str] = ()) -> Segments:
        """A reduction of each segment, as a scalar that later regions can capture."""
        x, make, _ = self._aggregate(kind, region, captures)
        if self.hot is not None:
            found = self.elements.groupBy("sid").agg(make(x).alias(name), F.count("*").alias("__n"))
            large = found.where(F.col("__n") > self.hot).select("sid", F.col(name).alias("__hot"), F.lit(True).alias("__is_hot"))  # at most rows / hot
            marked = self.elements.join(F.broadcast(large), "sid", "left")
            cold = marked.where("__is_hot IS NULL").drop("__hot", "__is_hot").join(found.where(F.col("__n") <= self.hot).drop("__n"), "sid")
            wide = marked.where("__is_hot").withColumnRenamed("__hot", name).drop("__is_hot")
            return Segments(self.domain, cold.unionByName(wide), (*self.captured, name), self.hot)
        over = Window.partitionBy("sid")
        if make is nan_min:
            value = F.when(F.max(F.isnan(x)).over(over), F.lit(float("nan"))).otherwise(F.min(x).over(over))
        else:
            value = make(x).over(over)
        return Segments(self.domain, self.elements.withColumn(name, value), (*self.captured, name), self.hot)

    def with_scalars(self, scalars: DataFrame) -> Segments:
        """Scalars from a table with one row for each sid, as captures."""
        names = [c for c in scalars.columns if c != "sid"]
        return Segments(self.domain, self.elements.join(scalars, "sid", "left"), (*self.captured, *names), self.hot)

    def map_store(self, region: Region, captures: Sequence[str] = (), name: str = "out") -> DataFrame:
        """(sid, pos, out): each element transformed, in its own place."""
        if "pos" not in self.elements.columns:
            raise CompilationError("map_store needs positions: give an order")
        out, _ = self._checked(region, captures)
        return self.elements.select("sid", "pos", out.alias(name))

    def zip(self, other: Segments, region: Region, name: str = "out") -> DataFrame:
        """(sid, pos, out) of a region over the elements of two segments at equal places; unequal extents raise."""
        if "pos" not in self.elements.columns or "pos" not in other.elements.columns:
            raise CompilationError("zip needs positions: give an order")
        a = self.elements.select("sid", "pos", F.col("v").alias("a"), F.lit(True).alias("has_a"))
        b = other.elements.select("sid", "pos", F.col("v").alias("b"), F.lit(True).alias("has_b"))
        region_type(self.elements.sparkSession, region, self.kind, [("b", other.kind)])
        both = a.join(b, ["sid", "pos"], "full")
        matched = F.col("has_a").isNotNull() & F.col("has_b").isNotNull()
        return both.select("sid", "pos", F.when(matched, region(F.col("a"), F.col("b"))).otherwise(F.raise_error(F.lit("zipped segments must have equal extents"))).alias(name))

    def softmax(self, name: str = "out") -> DataFrame:
        """Stable softmax inside each segment: three stages over one shuffle, or in parts after :meth:`spread`."""
        s = self.map(lambda x: x.cast("double")).capture("m", "max").capture("d", "sum", lambda x, m: F.exp(x - m), ["m"])
        return s.map_store(lambda x, m, d: F.exp(x - m) / d, ["m", "d"], name)
