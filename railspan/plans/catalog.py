"""All queries of the engine, by group."""

from . import queries_area, queries_graph, queries_joins, queries_scalar, queries_tables, queries_text, queries_tracks  # noqa: F401
