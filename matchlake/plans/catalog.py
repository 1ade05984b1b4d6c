"""Every registered query of the library and, where SQL can express it, the same in SQL."""

from __future__ import annotations

from .base import ORACLES, QUERIES
from . import alignment, annotations, classification, flows, graph, packing, records, sampling, scalars, spotting  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
