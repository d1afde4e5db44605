"""All registered queries and their SQL."""

from __future__ import annotations

from . import linking_oracles, linking_queries, oracles, queries, store_oracles, store_queries  # noqa: F401

#: The other query modules add their own to the same register as they are imported.
QUERIES = queries.QUERIES
ORACLES = oracles.ORACLES | linking_oracles.ORACLES | store_oracles.ORACLES
