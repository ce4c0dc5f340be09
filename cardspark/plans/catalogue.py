"""All registered queries with their oracles."""

from __future__ import annotations

from cardspark.plans import algebra, answers, estimates, models, relational  # noqa: F401  each registers its queries
from cardspark.plans.registry import ORACLES, QUERIES, Query

FLAGSHIP = "outer_join_identity"


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
