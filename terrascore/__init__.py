"""Territorial indicators, scores and serving queries as Spark DataFrames."""

from terrascore.session import build_session, configure

__all__ = ["build_session", "configure"]
__version__ = "0.1.0"
