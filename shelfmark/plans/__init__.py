"""Runnable plans: every operator applied to the given tables."""

from . import document_queries  # noqa: F401
from . import gate_queries  # noqa: F401
from . import pick_queries  # noqa: F401
from . import scalar_queries  # noqa: F401
from . import source_queries  # noqa: F401
from . import workflows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
