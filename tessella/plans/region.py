"""Checks of regions, the functions over columns that maps and reductions apply.

A region gets the element and the captured scalars as columns and returns a
column.  It is tried on an empty DataFrame that has just those columns, which
shows at plan time whether it reaches for anything else, and its result type.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompilationError
from ..functions.scalar import is_element_type

Region = Callable[..., Column]


def region_type(spark: SparkSession, region: Region, element: T.DataType, captures: Sequence[tuple[str, T.DataType]] = ()) -> T.DataType:
    """Result type of ``region``; raises :class:`CompilationError` if it is not one over its arguments."""
    if not is_element_type(element):
        raise CompilationError(f"element type must be an integer or float, not {element.simpleString()}")
    for name, kind in captures:
        if not is_element_type(kind):
            raise CompilationError(f"capture {name!r} must be an integer or float, not {kind.simpleString()}")
    names = ["__element", *(name for name, _ in captures)]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, [element, *(k for _, k in captures)])])
    try:
        out = region(*(F.col(f"`{n}`") for n in names))
    except TypeError as e:
        raise CompilationError(f"region must take the element and {len(captures)} captures: {e}") from e
    if not isinstance(out, Column):
        raise CompilationError("region must return a column")
    try:  # the bare element beside it makes an aggregate illegal
        plan = spark.createDataFrame([], schema).select("__element", out.alias("__out"))
        kind = plan.schema["__out"].dataType
    except AnalysisException as e:
        raise CompilationError(f"region must use nothing but its element and captures: {e.getCondition() or e}") from e
    if not is_element_type(kind):
        raise CompilationError(f"region must yield an integer or float, not {kind.simpleString()}")
    analysed = plan._jdf.queryExecution().analyzed()
    if not analysed.deterministic() or "PythonUDF" in analysed.prettyJson():
        raise CompilationError("region must be deterministic and made of built-in functions")
    return kind
