"""Logical plans: segments, regions and deferred programs."""

from .program import jit  # noqa: F401
from .region import region_type  # noqa: F401
from .segments import Segments  # noqa: F401
