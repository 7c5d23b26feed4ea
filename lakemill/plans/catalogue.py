"""The query catalogue: importing the plans registers them."""

from lakemill.plans import chains, ecommerce, medallion, relational, storage, warehouse
from lakemill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "chains", "ecommerce", "medallion", "relational", "storage", "warehouse"]
