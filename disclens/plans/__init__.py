"""Every runnable query, registered by name."""

from disclens.plans import (  # noqa: F401
    basket_queries,
    disclosure_queries,
    extraction_queries,
    governance_queries,
    product_queries,
)
from disclens.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
