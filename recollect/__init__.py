"""Searchable text memory and session analytics on Spark DataFrames."""

from recollect.session import build_session
from recollect.settings import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings", "build_session"]
