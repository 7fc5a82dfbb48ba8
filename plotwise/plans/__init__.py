from . import access, analytics, cleaning, polygons, scenarios, spatial  # noqa: F401  they register their queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
