"""The registered queries: importing the package fills the registry."""

from . import catalogue_queries, field_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalogue_queries", "field_queries"]
