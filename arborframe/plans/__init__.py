"""Queries over the data set's tables, with their SQL."""

from . import mesh_queries, queries, work_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
