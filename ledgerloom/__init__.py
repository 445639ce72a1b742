"""General ledger and financial statements over journal-entry tables, on Spark."""

from ledgerloom.sources.books import Books, load_books, table_books

__all__ = ["Books", "load_books", "table_books"]
