"""Registered queries of the engine's own operators over the driver's tables."""

from . import assembly, grids, index_space, masks, volumes  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
