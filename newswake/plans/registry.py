"""Imports every module that registers queries."""

from newswake.plans import (  # noqa: F401
    disclosure_queries,
    gap_queries,
    search_queries,
    source_queries,
    stream_queries,
    text_queries,
)
from newswake.plans.catalog import ORACLES, QUERIES  # noqa: F401
