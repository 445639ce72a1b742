"""The ledger and the statements as named views, for SQL users."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ledgerloom.operators import ledger, pivot, statements
from ledgerloom.operators.reports import report_lines
from ledgerloom.sources.books import Books


def register_views(
    books: Books, prefix: str = "", today=None, reports: DataFrame | None = None, names: Iterable[str] | None = None
) -> dict[str, DataFrame]:
    """Publish (or replace) the views; nothing is computed until one is queried. ``reports``, a
    frame of definitions, adds their lines. ``names`` restricts the views: the others are not even
    planned."""
    makers = {
        "general_ledger": lambda: ledger.general_ledger(books),
        "income_statement": lambda: statements.income_statement(books, today=today),
        "balance_sheet": lambda: statements.balance_sheet(books, today=today),
        "cash_flow": lambda: statements.cash_flow(books, today=today),
        "report_pivot": lambda: pivot.report_pivot_json(books),
    }
    if reports is not None:
        makers["report_lines"] = lambda: report_lines(books, reports)
    wanted = list(makers) if names is None else list(names)
    if unknown := set(wanted) - set(makers):
        raise ValueError(f"no such views: {sorted(unknown)}")
    views = {name: makers[name]() for name in wanted}
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return views
