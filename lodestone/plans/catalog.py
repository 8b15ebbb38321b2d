"""All registered queries and their SQL counterparts."""

from lodestone.plans import corpus, files, layout, text, tokens, training  # noqa: F401  they register their queries
from lodestone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
