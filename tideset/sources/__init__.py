"""Readers of interaction streams and writers of results."""

from .readers import directed, from_events, from_orders, read_edges, read_interactions, read_map, read_nodes, read_weighted
from .writers import write_nodes, write_series, write_snapshot

__all__ = ["directed", "from_events", "from_orders", "read_edges", "read_interactions", "read_map", "read_nodes", "read_weighted", "write_nodes", "write_series", "write_snapshot"]
