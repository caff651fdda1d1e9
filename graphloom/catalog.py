"""Queries over the reference tables and the SQL that states the same."""

from __future__ import annotations

from graphloom import catalog_data, catalog_graph, catalog_store, catalog_telemetry, catalog_text


def queries() -> dict:
    return catalog_graph.Q | catalog_data.Q | catalog_store.Q | catalog_telemetry.Q | catalog_text.Q


def oracle_sql() -> dict[str, str]:
    return catalog_graph.O | catalog_data.O | catalog_store.O | catalog_telemetry.O | catalog_text.O
