"""One query or more for each family of operators, over the views of ``testbed``."""

from wavecrate.queries import extra, linkage, listings, more, rest, scoring, streams, upkeep  # noqa: F401
from wavecrate.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
