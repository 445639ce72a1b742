"""Registered queries by name: each takes (spark, sf_dir) and returns a lazy frame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ledgerloom.functions.amounts import money
from ledgerloom.operators import ledger, pivot, reports, statements
from ledgerloom.plans import definitions as d
from ledgerloom.sources import pages, report_store, sql_functions, standing, text_index, tpch, views
from ledgerloom.sources.books import Books, by_month, report_definitions, stored
from ledgerloom.sources.schemas import MONEY

Query = Callable[[SparkSession, str], DataFrame]

# Parameters, shared with the oracle.
TODAY = "2001-01-01"
PERIOD = ("1996-03-01", "1997-02-28")
AS_OF = "1997-12-31"
PAGE = 80
LATE, VERY_LATE, LATER_PERIOD = ("1995-06-01", "1996-01-31"), "1998-05-01", ("1998-06-10", "1998-07-31")
HOT_ACCOUNT, HOT_DAY, HOT_SPAN = 2, "1996-06-30", 10 * tpch.IDS_PER_ORDER
PAGE_NUMBER, PAGE_RANGE = 57, 5_000
ANALYTIC_CODES = [f"AN{n:09d}" for n in range(1, 8)]


def _on_books(make: Callable[[Books], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(tpch.tpch_books(spark, sf_dir))


def _stored_books(spark: SparkSession, sf_dir: str) -> Books:
    """The books with their lines derived once, for queries that read them several times."""
    return stored(tpch.tpch_books(spark, sf_dir), report_store.scratch_table(spark, "books"))


def _batch(batch: list[tuple], spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_lines(tpch.tpch_books(spark, sf_dir), d.definitions(spark, batch))


def _with_hot_day(books: Books) -> Books:
    """The same books with a third of all lines moved to one account and day."""
    hot = F.col("id") % 3 == 0
    return replace(books, lines=books.lines.withColumns({
        "account_id": F.when(hot, F.lit(HOT_ACCOUNT).cast("long")).otherwise(F.col("account_id")),
        "date": F.when(hot, F.lit(HOT_DAY).cast("date")).otherwise(F.col("date")),
    }))


def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, rejected = reports.validate_reports(tpch.customer_requests(spark, sf_dir))
    return (
        ok.withColumn("problems", F.lit("")).unionByName(rejected)
        .select("report_id", "name", "report_type", "date_start", "date_end", "problems")
    )


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = d.definitions(spark, d.MIXED)
    return reports.report_totals(reports.report_lines(tpch.tpch_books(spark, sf_dir), batch), batch)


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = report_store.scratch_table(spark, "report_store")
    run = report_store.run_reports(tpch.tpch_books(spark, sf_dir), d.definitions(spark, d.MIXED), path)
    return run.lines


def _refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_store.read_report_lines(spark, _refreshed(spark, sf_dir))


def _refreshed(spark: SparkSession, sf_dir: str) -> str:
    """A store whose reports ran once, and some again after their definitions changed."""
    path = report_store.scratch_table(spark, "report_refresh")
    books = tpch.tpch_books(spark, sf_dir)
    report_store.run_reports(books, d.definitions(spark, d.STORED), path)
    report_store.refresh_reports(books, d.definitions(spark, d.REFRESHED), path, list(d.CHANGED))
    return path


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_store.read_report_headers(spark, _refreshed(spark, sf_dir))


def _late() -> Column:
    """Lines that are posted after the others: some days of an account, back-dated ones among them."""
    return ((F.col("id") % 7 == 3) & F.col("date").between(*LATE)) | (F.col("date") >= VERY_LATE)


def _before_late(books: Books) -> Books:
    return replace(books, lines=books.lines.where(~F.coalesce(_late(), F.lit(False))))


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that ran before the late lines came, and then again where they show."""
    path = report_store.scratch_table(spark, "report_touched")
    books, batch = _stored_books(spark, sf_dir), d.definitions(spark, d.STORED)
    report_store.run_reports(_before_late(books), batch, path)
    report_store.refresh_touched(books, batch, books.lines.where(_late()), path)
    return report_store.read_report_lines(spark, path)


def _store_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers beside the number and sum of their lines, by the catalog's views after a second batch."""
    path = report_store.scratch_table(spark, "report_views")
    name = f"reports_{path.rsplit('-', 1)[1]}"
    books = tpch.tpch_books(spark, sf_dir)
    report_store.run_reports(_before_late(books), d.definitions(spark, d.STORED), path)
    report_store.register_reports(spark, path, name)
    report_store.run_reports(books, d.definitions(spark, d.REFRESHED), path)
    report_store.register_reports(spark, path, name)
    return spark.sql(f"""SELECT report_id, h.name, total_balance, count(account_id) AS line_count,
      CAST(coalesce(sum(balance), 0) AS DECIMAL(28,2)) AS line_balance
      FROM {name}_headers h LEFT JOIN {name}_lines l USING (report_id) GROUP BY ALL""")


def _standing(period: tuple[str, str], fold: bool) -> Query:
    """The ledger of a period by stored balances, built before the late lines were posted."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = report_store.scratch_table(spark, "standing")
        books = _stored_books(spark, sf_dir)
        standing.build(_before_late(books), path)
        standing.post(books, books.lines.where(_late()), path)
        if fold:
            standing.fold(spark, path)
        return ledger.ledger_between(books, *period, carried=standing.carried(spark, path, period[0]))

    return run


def _variant(books: Books) -> DataFrame:
    rows = pivot.report_pivot_variant(books)
    return rows.select(
        "account_id", "account_code", "account_name", "company_id", *[pivot.balance_of(code) for code in ANALYTIC_CODES],
        "balance_without_analytic", "total_balance", "currency_id",
    )


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of the balance, observed while the sheet of each company is written, beside the sheet's totals."""
    check = Observation("balance")
    path = report_store.scratch_table(spark, "balance_sheet")
    statements.balance_sheet(tpch.tpch_books(spark, sf_dir), scope="company", today=TODAY, observation=check).write.parquet(path)
    found = check.get
    return spark.read.parquet(path).agg(
        money(F.sum("total_assets")).alias("sheet_assets"), money(F.sum("total_liabilities_equity")).alias("sheet_claims"),
        *[F.lit(found[name]).cast("long" if name == "lines" else MONEY).alias(name) for name in
          ("lines", "total_assets", "total_liabilities_equity", "difference", "period_result", "unexplained")],
    )


def _indexed(**terms) -> Query:
    """A search by an index built before the late lines came, which were added to it."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = report_store.scratch_table(spark, "text_index")
        books = _stored_books(spark, sf_dir)
        early = _before_late(books)
        entries = early.lines.select(F.col("move_id").alias("id")).distinct()
        text_index.build(replace(early, moves=books.moves.join(entries, "id", "left_semi")), path)
        text_index.add(books, books.lines.where(_late()), path)
        return text_index.ledger_search(books, path, **terms)

    return run


def _view(name: str, text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        books, batch = tpch.tpch_books(spark, sf_dir), d.definitions(spark, d.FLAT)
        views.register_views(books, prefix="books_", today=TODAY, reports=batch, names=[name])
        return spark.sql(text.format(f"books_{name}"))

    return run


def _with_gaps(books: Books) -> Books:
    """The same books with some lines whose entry or company does not exist, so that the checks matter."""
    missing = F.when(F.col("id") % 2 == 0, F.lit(-1)).cast("long")
    return replace(books, complete=False, lines=books.lines.withColumns({
        "move_id": F.when(F.col("id") % 13 == 3, missing).otherwise(F.col("move_id")),
        "company_id": F.when(F.col("id") % 11 == 5, missing).otherwise(F.col("company_id")),
    }))


def _from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed batch with its definitions written to files and read from there."""
    path = report_store.scratch_table(spark, "definitions")
    d.definitions(spark, d.MIXED).write.parquet(f"{path}/report_definition")
    return reports.report_lines(tpch.tpch_books(spark, sf_dir), report_definitions(spark, path))


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page by its number from the stored ledger."""
    path = report_store.scratch_table(spark, "pages")
    pages.build(tpch.tpch_books(spark, sf_dir), path, PAGE_RANGE)
    return pages.page(spark, path, PAGE_NUMBER, PAGE)


def _page_on_hot_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page where the day with a third of all lines begins, from the stored ledger."""
    path = report_store.scratch_table(spark, "pages")
    pages.build(_with_hot_day(tpch.tpch_books(spark, sf_dir)), path, PAGE_RANGE)
    return pages.page_after(spark, path, HOT_ACCOUNT, HOT_DAY, 0, PAGE)


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports on periods far apart, from lines stored by month."""
    books = by_month(tpch.tpch_books(spark, sf_dir), report_store.scratch_table(spark, "by_month"))
    return reports.report_lines(books, d.definitions(spark, d.SPARSE))


def _all_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pivot with a column for each label in the data, from blocks of 64."""
    return pivot.pivot_blocks(tpch.tpch_books(spark, sf_dir), report_store.scratch_table(spark, "pivot"), 64).whole()


def _function(call: str, company: int | None = None) -> Query:
    """A statement by its SQL function, after the session's company was set."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql_functions.register_functions(tpch.tpch_books(spark, sf_dir), "books_")
        if company is not None:
            spark.sql(f"SET VARIABLE books_default_company = {company}")
        return spark.sql(f"SELECT * FROM books_{call}")

    return run


QUERIES: dict[str, Query] = {
    "ledger_base": _on_books(ledger.ledger_base),
    "general_ledger": _on_books(ledger.general_ledger),
    "general_ledger_bucketed": _on_books(lambda b: ledger.general_ledger(_with_hot_day(b), id_span=HOT_SPAN)),
    "ledger_list": _on_books(lambda b: ledger.general_ledger(b).select(*ledger.LIST_COLUMNS)),
    "ledger_first_page": _on_books(partial(ledger.ledger_first_page, size=PAGE)),
    "ledger_between": _on_books(lambda b: ledger.ledger_between(b, *PERIOD)),
    "ledger_search": _on_books(lambda b: ledger.ledger_search(b, journal_id=3, ref="n")),
    "ledger_search_account": _on_books(lambda b: ledger.ledger_search(b, account_id=7)),
    "ledger_search_entry": _on_books(lambda b: ledger.ledger_search(b, move_name="move/7")),
    "ledger_search_indexed": _indexed(move_name="move/77"),
    "ledger_search_indexed_ref": _indexed(journal_id=3, ref="n"),
    "ledger_by_account": _on_books(partial(ledger.ledger_groups, by="account_id")),
    "ledger_by_journal": _on_books(partial(ledger.ledger_groups, by="journal_id")),
    "ledger_by_partner": _on_books(partial(ledger.ledger_groups, by="partner_id")),
    "ledger_rollup": _on_books(partial(ledger.ledger_groups, by="partner_id", totals=True)),
    "ledger_nested_groups": _on_books(
        partial(ledger.ledger_groups, by=["account_id", "journal_id"], totals=True)
    ),
    "ledger_drill_through": _on_books(lambda b: ledger.move_of_line(b, F.col("ref") == "RF")),
    "ledger_views": _view("general_ledger", """
        SELECT account_id, count(*) AS line_count, CAST(sum(debit) AS DECIMAL(28,2)) AS debit,
          max_by(balance, struct(date IS NULL, date, id)) AS last_balance, CAST(sum(balance) AS DECIMAL(38,2)) AS balances
        FROM {} GROUP BY account_id"""),
    "income_view": _view("income_statement", "SELECT * FROM {}"),
    "balance_view": _view("balance_sheet", "SELECT * FROM {}"),
    "cash_flow_view": _view("cash_flow", "SELECT * FROM {}"),
    "report_lines_view": _view("report_lines", "SELECT * FROM {}"),
    "report_pivot_view": _view("report_pivot", "SELECT account_id, company_id, analytic_data, total_balance FROM {}"),
    "ledger_with_gaps": _on_books(lambda b: ledger.general_ledger(_with_gaps(b))),
    "ledger_groups_with_gaps": _on_books(lambda b: ledger.ledger_groups(_with_gaps(b), "account_id")),
    "balance_sheet_with_gaps": _on_books(lambda b: statements.balance_sheet(_with_gaps(b), today=TODAY)),
    "income_statement_with_gaps": _on_books(lambda b: statements.income_statement(_with_gaps(b), today=TODAY)),
    "ledger_between_stored_balances": _standing(PERIOD, fold=False),
    "ledger_between_folded_balances": _standing(LATER_PERIOD, fold=True),
    "ledger_next_page": _on_books(partial(ledger.ledger_next_page, account_id=7, date=AS_OF, id=0, size=PAGE)),
    "ledger_page_stored": _page,
    "ledger_page_on_hot_day": _page_on_hot_day,
    "ledger_search_account_text": _on_books(lambda b: ledger.ledger_search(b, account="10110000")),
    "income_statement": _on_books(partial(statements.income_statement, today=TODAY)),
    "income_statement_period": _on_books(
        lambda b: statements.income_statement(b, date_start=PERIOD[0], date_end=PERIOD[1])
    ),
    "income_statement_list": _on_books(
        lambda b: statements.list_view(
            statements.income_statement(b, today=TODAY), statements.INCOME_LIST_COLUMNS
        )
    ),
    "balance_sheet": _on_books(partial(statements.balance_sheet, today=TODAY)),
    "balance_sheet_as_of": _on_books(partial(statements.balance_sheet, as_of=AS_OF, scope="company")),
    "balance_sheet_list": _on_books(
        lambda b: statements.list_view(statements.balance_sheet(b, today=TODAY), statements.BALANCE_LIST_COLUMNS)
    ),
    "balance_check": _on_books(statements.balance_check),
    "balance_check_by_company": _on_books(partial(statements.balance_check, scope="company")),
    "cash_flow": _on_books(partial(statements.cash_flow, today=TODAY)),
    "cash_flow_by_company": _on_books(partial(statements.cash_flow, today=TODAY, scope="company")),
    "income_statement_of_company": _on_books(partial(statements.income_statement, today=TODAY, company_id=3)),
    "balance_sheet_of_company": _on_books(partial(statements.balance_sheet, today=TODAY, company_id=3)),
    "cash_flow_of_company": _on_books(partial(statements.cash_flow, today=TODAY, company_id=3, scope="company")),
    "cash_flow_period": _on_books(
        lambda b: statements.cash_flow(b, date_start=PERIOD[0], date_end=PERIOD[1])
    ),
    "cash_flow_list": _on_books(
        lambda b: statements.list_view(statements.cash_flow(b, today=TODAY), statements.CASH_FLOW_LIST_COLUMNS)
    ),
    "income_statement_function": _function(f"income_statement(NULL, DATE '{PERIOD[0]}', DATE '{PERIOD[1]}')"),
    "balance_sheet_function": _function(f"balance_sheet(as_of => DATE '{AS_OF}', scope => 'company')"),
    "cash_flow_function": _function(f"cash_flow(date_start => DATE '{PERIOD[0]}', date_end => DATE '{PERIOD[1]}')", company=3),
    "report_validation": _validation,
    "report_lines": partial(_batch, d.MIXED),
    "report_income": partial(_batch, d.of_type("income")),
    "report_balance": partial(_batch, d.of_type("balance")),
    "report_cashflow": partial(_batch, d.of_type("cashflow")),
    "report_lines_flat": partial(_batch, d.FLAT),
    "report_lines_zero": partial(_batch, d.ZERO),
    "report_lines_analytic_filter": partial(_batch, d.ANALYTIC),
    "report_lines_sparse": _sparse,
    "report_totals": _totals,
    "report_store": _store,
    "report_refresh": _refresh,
    "report_headers": _headers,
    "report_refresh_touched": _touched,
    "report_store_views": _store_views,
    "report_lines_from_files": _from_files,
    "report_pivot_json": _on_books(pivot.report_pivot_json),
    "report_pivot_variant": _on_books(_variant),
    "report_pivot_all_labels": _all_labels,
    "balance_sheet_observed": _observed,
    "report_pivot": _on_books(partial(pivot.report_pivot, codes=ANALYTIC_CODES)),
}
