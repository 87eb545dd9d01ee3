"""Registered queries of the subpackage, and their SQL twins."""

from __future__ import annotations

from cellwise.llm import queries_algorithms, queries_texts

QUERIES = {**queries_algorithms.QUERIES, **queries_texts.QUERIES}
ORACLES = {**queries_algorithms.ORACLES, **queries_texts.ORACLES}
