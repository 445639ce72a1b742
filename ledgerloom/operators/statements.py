"""Income statement, balance sheet and cash flow, one row per company.

Each statement is one pass over the journal lines: subtotals per account first, so that
a busy account shrinks before anything is shuffled, then the named measures over the
account totals. The result hangs on the companies, which are few; a company without
lines has zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ledgerloom.functions.amounts import day, day_or_today, debit_less_credit, or_zero, within
from ledgerloom.operators import measures as m
from ledgerloom.sources.books import Books

# Titles of the statements.
INCOME_TITLE = "Estado de Resultados - "
BALANCE_TITLE = "Balance General - "
CASH_FLOW_TITLE = "Flujo de Caja - "
UNNAMED_COMPANY = "Compañía"

INCOME_LIST_COLUMNS = [
    "name", "date_start", "date_end", "revenue", "cost_of_sales", "gross_profit",
    "operating_income", "net_income",
]
BALANCE_LIST_COLUMNS = [
    "name", "date", "total_assets", "total_liabilities", "total_equity", "total_liabilities_equity",
]
CASH_FLOW_LIST_COLUMNS = [
    "name", "date_start", "date_end", "cash_from_operations", "cash_from_investing",
    "cash_from_financing", "net_change_cash", "ending_cash",
]

GLOBAL = "global"
COMPANY = "company"
COMPANY_KEY = "company_id"


def income_statement(
    books: Books, company_id: int | None = None, date_start=None, date_end=None, today=None
) -> DataFrame:
    """Income statement of each company, over all time or over a period.

    A line counts when its *entry* is posted. An expense account without code is in
    neither cost of sales nor operating expenses, but it is in operating income.
    """
    posted = books.moves.where(F.col("state") == "posted").select(F.col("id").alias("move_id"))
    relevant = books.accounts.where(m.is_type(m.INCOME, m.EXPENSE)).select(F.col("id").alias("account_id"))
    # Only lines of these accounts, and four columns of them, go to meet the entries.
    lines = (
        books.between(date_start, date_end)
        .select("move_id", "account_id", COMPANY_KEY, debit_less_credit().alias("amount"))
        .join(relevant, "account_id", "left_semi")
        .join(posted, "move_id", "left_semi")
    )
    accounts = _account_totals(books, lines, [COMPANY_KEY], amount=F.col("amount"))
    totals = _measure_totals(accounts, m.income_measures(), COMPANY)
    revenue, cost = or_zero(F.col("revenue")), or_zero(F.col("cost_of_sales"))
    net = revenue - or_zero(F.col("all_expenses"))
    header = _header(books, INCOME_TITLE, company_id, _dates(date_start, date_end, today))
    return _attach(header, totals, COMPANY).select(
        *header.columns,
        *_amounts(
            revenue=revenue,
            cost_of_sales=cost,
            gross_profit=revenue - cost,
            operating_expenses=F.col("operating_expenses"),
            operating_income=net,
            other_income=F.lit(0),
            other_expenses=F.lit(0),
            net_income=net,
        ),
    )


def balance_sheet(
    books: Books, as_of=None, company_id: int | None = None, scope: str = GLOBAL, today=None,
    observation: Observation | None = None,
) -> DataFrame:
    """Balance sheet, over all time or up to and including ``as_of``.

    In the ``global`` scope every company shows the totals of all lines, also of lines
    without company; in the ``company`` scope each shows its own.

    With an ``observation``, which the company scope allows, whoever runs the sheet also gets the global
    figures of ``balance_check`` and the number of lines behind them, from the same pass. Spark may drop it from
    the plan of books without any line; waiting for it then never ends.
    """
    if observation is not None and scope != COMPANY:
        raise ValueError("only the company scope can be observed: Spark does not report from within a subquery")
    measures = m.balance_measures()
    accounts = _balance_accounts(books, as_of, scope)
    if observation is not None:
        accounts = accounts.observe(observation, *_checks())
    totals = _measure_totals(accounts, measures, scope)
    header = _header(books, BALANCE_TITLE, company_id, {"date": day_or_today(as_of or today)})
    return _attach(header, totals, scope).select(
        *header.columns, *_amounts(**{name: F.col(name) for name in measures})
    )


def _checks() -> list[Column]:
    """What is observed on account totals: both sides, the result, and what is between them."""
    sheet = m.balance_measures()
    assets, claims = (or_zero(sheet[name].total()) for name in ("total_assets", "total_liabilities_equity"))
    result = or_zero(m.result_measure().total())
    return [
        F.sum("line_count").alias("lines"), assets.alias("total_assets"), claims.alias("total_liabilities_equity"),
        or_zero(assets - claims).alias("difference"), result.alias("period_result"), or_zero(assets - claims - result).alias("unexplained"),
    ]


def balance_check(books: Books, as_of=None, company_id: int | None = None, scope: str = GLOBAL) -> DataFrame:
    """Both sides of the balance sheet and what is between them.

    ``difference`` is assets less liabilities and equity. It equals the result of the
    accounts that were never closed, so on balanced entries ``unexplained`` is zero.
    """
    sheet = m.balance_measures()
    measures = {
        "total_assets": sheet["total_assets"],
        "total_liabilities_equity": sheet["total_liabilities_equity"],
        "period_result": m.result_measure(),
    }
    totals = _measure_totals(_balance_accounts(books, as_of, scope), measures, scope)
    header = _header(books, BALANCE_TITLE, company_id, {}).select("company_id", "currency_id")
    assets, claims, result = (or_zero(F.col(name)) for name in measures)
    return _attach(header, totals, scope).select(
        *header.columns,
        *_amounts(
            total_assets=assets,
            total_liabilities_equity=claims,
            difference=assets - claims,
            period_result=result,
            unexplained=assets - claims - result,
        ),
    )


def cash_flow(
    books: Books, company_id: int | None = None, date_start=None, date_end=None, today=None, scope: str = GLOBAL
) -> DataFrame:
    """Cash flow statement.

    Without dates, every company shows the totals of all lines. Draft lines on ``681``
    and ``1011`` accounts count there, those on ``682`` and ``1012`` do not, and the
    beginning cash is the amount of the earliest posted cash line (lowest id of its day).

    With dates, each company shows its own posted lines: cash before the period, change
    inside it, and their sum. ``scope="company"`` without dates shows each company the measures
    of all time over its own lines.
    """
    if scope not in (GLOBAL, COMPANY):
        raise ValueError(f"unknown scope {scope!r}")
    header = _header(books, CASH_FLOW_TITLE, company_id, _dates(date_start, date_end, today))
    if date_start is None and date_end is None:
        totals = _cash_flow_all_time(books, scope)
        ending = F.col("net_change_cash")
    else:
        totals, scope = _cash_flow_period(books, date_start, date_end), COMPANY
        ending = or_zero(F.col("beginning_cash")) + or_zero(F.col("net_change_cash"))
    return _attach(header, totals, scope).select(
        *header.columns,
        *_amounts(
            net_income=F.col("net_income"),
            adjustments=F.col("adjustments"),
            cash_from_operations=F.col("net_income"),
            capital_expenditure=F.col("capital_expenditure"),
            cash_from_investing=F.lit(0),
            debt_payments=F.lit(0),
            equity_changes=F.lit(0),
            cash_from_financing=F.lit(0),
            net_change_cash=F.col("net_change_cash"),
            beginning_cash=F.col("beginning_cash"),
            ending_cash=ending,
        ),
    )


def list_view(statement: DataFrame, columns: list[str]) -> DataFrame:
    """The short form of a statement; measures left out are not computed."""
    return statement.select(*columns)


def _account_totals(books: Books, lines: DataFrame, keys: list[str], **amounts: Column) -> DataFrame:
    """Subtotals per account (and ``keys``) with the account's code and type."""
    accounts = books.accounts.select(F.col("id").alias("account_id"), "code", "internal_type")
    return (
        lines.groupBy("account_id", *keys)
        .agg(*[F.sum(amount).alias(name) for name, amount in amounts.items()], F.count("*").alias("line_count"))
        .join(accounts, "account_id")
    )


def _measure_totals(accounts: DataFrame, measures: dict[str, m.Measure], scope: str) -> DataFrame:
    keys = [COMPANY_KEY] if scope == COMPANY else []
    return accounts.groupBy(*keys).agg(*[one.total().alias(name) for name, one in measures.items()])


def _balance_accounts(books: Books, as_of, scope: str) -> DataFrame:
    if scope not in (GLOBAL, COMPANY):
        raise ValueError(f"unknown scope {scope!r}")
    lines = books.between(None, as_of).where(F.col("parent_state") == "posted")
    keys = [COMPANY_KEY] if scope == COMPANY else []
    return _account_totals(books, lines, keys, amount=debit_less_credit())


def _cash_flow_all_time(books: Books, scope: str = GLOBAL) -> DataFrame:
    keys = [COMPANY_KEY] if scope == COMPANY else []
    # What an account counts for is settled once per account; the lines meet only the flags.
    kinds = {
        "result": m.is_type(m.INCOME, m.EXPENSE),
        "depreciation": m.coded(m.DEPRECIATION_CODE),
        "provision": m.coded(m.PROVISION_CODE),
        "capital": m.coded(m.CAPITAL_CODE),
        "cash": m.coded(m.CASH_CODE),
        "bank": m.coded(m.BANK_CODE),
    }
    accounts = books.accounts.select(
        F.col("id").alias("account_id"),
        *[F.coalesce(kind, F.lit(False)).alias(name) for name, kind in kinds.items()],
    ).where(" or ".join(kinds))
    amount = debit_less_credit()
    posted = F.col("parent_state") == "posted"
    cash_id = F.when((F.col("cash") | F.col("bank")) & posted, F.col("id"))
    # Days first: there the earliest cash line is the one with the lowest id, a plain number,
    # so the pass over the lines is a hash aggregation. Dates are compared among days only.
    days = books.lines.join(accounts, "account_id").groupBy(*keys, "date").agg(
        F.sum(F.when(F.col("result") & posted, -amount)).alias("net_income"),
        F.sum(F.when(F.col("depreciation") | (F.col("provision") & posted), amount)).alias("adjustments"),
        F.sum(F.when(F.col("capital") & posted, amount)).alias("capital_expenditure"),
        F.sum(F.when(F.col("cash") | (F.col("bank") & posted), amount)).alias("net_change_cash"),
        F.min_by(amount, cash_id).alias("first_cash"),
        F.min(cash_id).alias("first_id"),
    )
    age = F.struct(F.col("date").isNull().alias("undated"), "date")
    sums = ("net_income", "adjustments", "capital_expenditure", "net_change_cash")
    return days.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in sums],
        F.min_by("first_cash", F.when(F.col("first_id").isNotNull(), age)).alias("beginning_cash"),
    )


def _cash_flow_period(books: Books, date_start, date_end) -> DataFrame:
    lines = books.between(None, date_end).where(F.col("parent_state") == "posted")
    inside = within(F.col("date"), date_start, date_end)
    accounts = _account_totals(
        books, lines, [COMPANY_KEY],
        amount=F.when(inside, debit_less_credit()),
        earlier=F.when(~inside, debit_less_credit()),
    )
    return accounts.groupBy(COMPANY_KEY).agg(
        m.result_measure().total().alias("net_income"),
        m.Measure(m.coded(m.DEPRECIATION_CODE) | m.coded(m.PROVISION_CODE)).total().alias("adjustments"),
        m.Measure(m.coded(m.CAPITAL_CODE)).total().alias("capital_expenditure"),
        m.Measure(m.is_cash()).total().alias("net_change_cash"),
        m.Measure(m.is_cash()).total("earlier").alias("beginning_cash"),
    )


def _dates(date_start, date_end, today) -> dict[str, Column]:
    """The period of a statement, an open end as null; without any period, today."""
    if date_start is None and date_end is None:
        date_start = date_end = day_or_today(today)
    return {"date_start": day(date_start), "date_end": day(date_end)}


def _header(books: Books, title: str, company_id: int | None, dates: dict[str, Column]) -> DataFrame:
    """Identity columns of a statement. Numbering all companies takes one task, for a
    table with one row per legal entity."""
    number = F.row_number().over(Window.orderBy("company_id")).cast("long")
    companies = books.companies.withColumnRenamed("id", "company_id").select(
        number.alias("id"),
        F.concat(F.lit(title), F.coalesce("name", F.lit(UNNAMED_COMPANY))).alias("name"),
        *[value.alias(name) for name, value in dates.items()],
        "company_id",
        "currency_id",
    )
    return companies if company_id is None else companies.where(F.col("company_id") == company_id)


def _attach(header: DataFrame, totals: DataFrame, scope: str) -> DataFrame:
    """Totals beside the companies: each its own, or the single row of totals for all."""
    if scope == COMPANY:
        return header.join(totals, COMPANY_KEY, "left")
    row = header.withColumn("totals", totals.select(F.struct("*")).scalar())
    return row.select(*header.columns, "totals.*")


def _amounts(**amounts: Column) -> list[Column]:
    return [or_zero(amount).alias(name) for name, amount in amounts.items()]
