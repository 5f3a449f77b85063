"""Registered queries over the driver tables, each with its SQL counterpart where one exists."""

from regweave.catalog.registry import ORACLES, QUERIES
from regweave.catalog import edges, files, model, selection, statistics  # noqa: F401  (fill the registry)

__all__ = ["ORACLES", "QUERIES"]
