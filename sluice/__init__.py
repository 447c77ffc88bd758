"""Confidence-routed text classification as PySpark jobs."""

from sluice.params import CascadeParams

__all__ = ["CascadeParams"]
