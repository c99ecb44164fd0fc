"""All named queries. Importing a module registers its queries."""

from tarnwheel.plans import documents, events, exchange, similarity, star, streams, texts  # noqa: F401
from tarnwheel.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
