"""All registered queries and their SQL equivalents."""

from . import joins_and_cleaning, portfolios_and_models, returns_and_windows, statistics  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
