"""Run statistics and small helpers."""

from .stats import RunStats

__all__ = ["RunStats"]
