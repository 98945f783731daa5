"""All queries over the driver tables and their SQL twins, gathered from the modules of this package."""

from __future__ import annotations

from newsgrain.plans import q_chains, q_collection, q_export, q_filters, q_ingest, q_rules, q_samples, q_streams

BOOKS = (q_collection.BOOK, q_ingest.BOOK, q_filters.BOOK, q_samples.BOOK, q_rules.BOOK, q_export.BOOK, q_chains.BOOK, q_streams.BOOK)
QUERIES = {name: f for book in BOOKS for name, f in book.queries.items()}
SQL = {name: text for book in BOOKS for name, text in book.sql.items()}
