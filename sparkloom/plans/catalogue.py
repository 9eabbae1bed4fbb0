"""Registered queries over the driver's tables, with their SQL twins."""

from __future__ import annotations

from sparkloom.plans import qa_queries, text_queries

QUERIES: dict = {**text_queries.QUERIES, **qa_queries.QUERIES}
ORACLES: dict[str, str] = {**text_queries.ORACLES, **qa_queries.ORACLES}
