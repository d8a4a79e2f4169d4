"""Deferred programs: functions over columns that are planned, not run, until asked."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import CompilationError


class Program:
    """A function (input DataFrame, **constants) -> DataFrame that is recorded and called only to build plans."""

    def __init__(self, function: Callable[..., DataFrame]) -> None:
        kinds = {p.kind for p in inspect.signature(function).parameters.values()}
        if kinds & {inspect.Parameter.VAR_POSITIONAL, inspect.Parameter.VAR_KEYWORD, inspect.Parameter.POSITIONAL_ONLY}:
            raise CompilationError(f"{function.__name__}: parameters must be plain names")
        self.function = function
        functools.update_wrapper(self, function)

    def __call__(self, *args: Any, **kwargs: Any) -> None:
        raise CompilationError(f"{self.__name__}: a program is not called; use plan() or run()")

    def plan(self, data: DataFrame, constants: Mapping[str, Any] | None = None, schema: T.StructType | None = None) -> DataFrame:
        """The lazy result.  ``schema``, if given, must be the input's; else the input's is taken."""
        constants = dict(constants or {})
        names = list(inspect.signature(self.function).parameters)[1:]
        missing = [n for n in names if n not in constants and inspect.signature(self.function).parameters[n].default is inspect.Parameter.empty]
        extra = [n for n in constants if n not in names]
        if missing or extra:
            raise CompilationError(f"{self.__name__}: missing constants {missing}, unexpected constants {extra}")
        if schema is not None:
            have = {f.name: f.dataType for f in data.schema}
            wrong = [f.name for f in schema if have.get(f.name) != f.dataType]
            if wrong:
                raise CompilationError(f"{self.__name__}: columns {wrong} don't have the types of the signature")
        try:
            out = self.function(data, **constants)
        except (AnalysisException, CompilationError) as e:
            raise CompilationError(f"{self._place(e)}: {self.__name__}: {e}") from e
        if not isinstance(out, DataFrame):
            raise CompilationError(f"{self.__name__}: a program must return a DataFrame")
        return out

    def _place(self, error: BaseException) -> str:
        """file:line:column of the expression of the program that raised; its first line where the traceback doesn't say."""
        code, place, trace = self.function.__code__, None, error.__traceback__
        while trace is not None:
            if trace.tb_frame.f_code is code:
                line, _, column, _ = list(code.co_positions())[trace.tb_lasti // 2]
                place = f"{code.co_filename}:{line or trace.tb_lineno}:{(column or 0) + 1}"
            trace = trace.tb_next
        return place or f"{code.co_filename}:{code.co_firstlineno}:1"

    def explain(self, data: DataFrame, constants: Mapping[str, Any] | None = None) -> None:
        self.plan(data, constants).explain("formatted")

    def run(self, data: DataFrame, path: str, constants: Mapping[str, Any] | None = None) -> None:
        """Writes the result as Parquet."""
        self.plan(data, constants).write.parquet(path)


def jit(function: Callable[..., DataFrame]) -> Program:
    return Program(function)
