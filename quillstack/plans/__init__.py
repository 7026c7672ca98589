"""Query plans over the library's relations."""

from __future__ import annotations

from . import catalog_queries, document_queries, editorial_queries, export_queries, folder_queries, glossary_queries, label_queries, placing_queries, record_queries, registry, structure_queries, text_queries, tree_queries

MODULES = (tree_queries, catalog_queries, document_queries, editorial_queries, export_queries, folder_queries, glossary_queries, label_queries, placing_queries, record_queries, structure_queries, text_queries)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE)
