"""The registered queries: importing this package fills queries.QUERIES and queries.ORACLES."""

from factloom.plans import item_queries, more_queries, queries  # noqa: F401
