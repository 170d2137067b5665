"""Named queries over the driver's tables."""

from weftline.plans import joining, label_queries, listing_queries, merging, post_queries, text_queries  # noqa: F401
from weftline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
