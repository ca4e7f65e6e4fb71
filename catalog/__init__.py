"""All registered queries."""

from . import assembly, basics, policies, ranking, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
