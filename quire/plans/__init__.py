"""The registered queries of the document engine, with DuckDB SQL for those that SQL can express."""

from . import containers, markup  # noqa: F401  they add their queries
from .catalogue import FLAGSHIP, oracle_sql, queries

__all__ = ["FLAGSHIP", "oracle_sql", "queries"]
