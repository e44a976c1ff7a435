"""Importing this module fills the registry."""

from tidewater.plans import (  # noqa: F401
    catalogue_queries, demand_queries, gold_queries, layer_queries, request_queries, rule_queries, stream_queries,
)
from tidewater.plans.registry import QUERIES, STATEMENTS  # noqa: F401
