"""Checked queries over the given tables."""

from veilframe.registry import discovery, files, generation, masking, runs  # noqa: F401
from veilframe.registry.base import QUERIES

__all__ = ["QUERIES"]
