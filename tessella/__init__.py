"""Variable-length segment analytics on Spark."""

from .errors import CompilationError  # noqa: F401
from .plans import Segments, jit  # noqa: F401
