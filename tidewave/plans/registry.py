"""All queries outside the llm subpackage, and the SQL that checks them."""

from __future__ import annotations

from tidewave.plans import analysis, corpus, marts, more, warehouse
from tidewave.plans.tables import Query

FLAGSHIP = "d7_best_episodes"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
for module in (corpus, warehouse, analysis, marts, more):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
