"""All registered queries."""

from storyloom.plans import (  # noqa: F401
    cluster_queries,
    score_queries,
    source_queries,
    table_queries,
    text_queries,
)
from storyloom.plans.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark, folder):
    return QUERIES["user_feeds"](spark, folder)
