"""Registered queries and their SQL twins."""

from cellwise.queries import core, general

QUERIES = {**core.QUERIES, **general.QUERIES}
ORACLES = {**core.ORACLES, **general.ORACLES}
