"""Registered queries. Importing this package registers them all."""

from decklens.plans import (  # noqa: F401
    catalog_queries,
    judge_queries,
    score_queries,
    shape_queries,
    text_queries,
    timing_queries,
)
from decklens.plans.registry import ORACLES, QUERIES  # noqa: F401
from decklens.plans.score_queries import deck_scores  # noqa: F401
