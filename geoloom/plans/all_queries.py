"""All registered queries of the library and their SQL twins."""

from . import queries_geo, queries_roads, queries_sources, queries_streams, queries_world  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
