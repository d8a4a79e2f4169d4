"""Column functions with the engine's edge semantics."""

from .scalar import float32, ieee_divide, identity, nan_max, nan_min, to_int  # noqa: F401
