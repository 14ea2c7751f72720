"""All registered queries. Importing the modules registers them."""

from __future__ import annotations

from ledgerline.plans import (  # noqa: F401
    fork_queries,
    mine_queries,
    record_queries,
    spend_queries,
    text_queries,
    timeline_queries,
)
from ledgerline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
