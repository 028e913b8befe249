"""All telemetry queries and their SQL twins."""

from . import archive, damaged, files, linkage, matching, paths, rolling, scalars, upkeep  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
