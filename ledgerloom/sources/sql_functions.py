"""The statements as SQL table functions with parameters, for users of SQL.

    SELECT * FROM income_statement(3, DATE '2024-01-01', DATE '2024-12-31');
    SELECT name, total_assets FROM balance_sheet(as_of => DATE '2024-12-31', scope => 'company');
    SET VARIABLE default_company = 3;
    SELECT * FROM cash_flow();

A parameter left out is null, and means what None means to the functions of ``operators.statements``, whose rows
these return. Without a company, the session's ``default_company`` is shown; where that is null, too, all are. Spark
inlines a call into the query around it: constant dates reach the scan as literals, and columns
that a query does not use are not computed.

Functions, views and the variable belong to the session. A name may have a prefix.
"""

from __future__ import annotations

from ledgerloom.operators import measures as m
from ledgerloom.operators.statements import BALANCE_TITLE, CASH_FLOW_TITLE, INCOME_TITLE, UNNAMED_COMPANY
from ledgerloom.sources.books import Books
from ledgerloom.sources.schemas import MONEY

_MONEY = MONEY.simpleString()
_POSTED = "parent_state = 'posted'"


def _type(*names: str) -> str:
    return f"internal_type IN ({', '.join(repr(n) for n in names)})"


def _code(prefix: str) -> str:
    return f"startswith(code, '{prefix}')"


def _sum(condition: str, name: str, credit: bool = False, amount: str = "amount") -> str:
    return f"sum({'-' if credit else ''}{amount}) FILTER (WHERE {condition}) AS {name}"


def _zero(amount: str, name: str) -> str:
    return f"CAST(coalesce({amount}, 0) AS {_MONEY}) AS {name}"


def _only(company: str) -> str:
    """Rows of the company that is asked for, or else of the session's; where there is neither, all."""
    own = f"coalesce({company}, {{p}}default_company)"
    return f"({own} IS NULL OR company_id = {own})"


def _header(title: str, dates: str, company: str) -> str:
    """The companies asked for, numbered among all."""
    return f"""SELECT * FROM (
      SELECT row_number() OVER (ORDER BY id) AS id, concat('{title}', coalesce(name, '{UNNAMED_COMPANY}')) AS name,
        {dates}, id AS company_id, currency_id FROM {{p}}book_companies)
    WHERE {_only(company)}"""


def _columns(amounts: dict[str, str]) -> str:
    return ", ".join(_zero(amount, name) for name, amount in amounts.items())


def _define(name: str, parameters: dict[str, str], dates: list[str], amounts: dict[str, str], body: str) -> str:
    given = ", ".join(f"{one} {kind}" for one, kind in parameters.items())
    returned = ", ".join([
        "id BIGINT", "name STRING", *(f"{one} DATE" for one in dates), "company_id BIGINT", "currency_id BIGINT",
        *(f"{one} {_MONEY}" for one in amounts),
    ])
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {{p}}{name}({given}) RETURNS TABLE({returned}) RETURN {body}"


_PERIOD = {"company": "BIGINT DEFAULT NULL", "date_start": "DATE DEFAULT NULL", "date_end": "DATE DEFAULT NULL"}


def _own(function: str, *names: str) -> list[str]:
    """Parameters by their full names: a column of the same name would hide them otherwise."""
    return [f"{{p}}{function}.{name}" for name in names]


def _period_dates(start: str, end: str) -> str:
    return ", ".join(
        f"CASE WHEN {start} IS NULL AND {end} IS NULL THEN current_date() ELSE {value} END AS {name}"
        for value, name in ((start, "date_start"), (end, "date_end"))
    )


def _inside(start: str, end: str) -> str:
    return f"({start} IS NULL OR date >= {start}) AND ({end} IS NULL OR date <= {end})"


def _income() -> str:
    company, start, end = _own("income_statement", *_PERIOD)
    expense = _type(m.EXPENSE)
    amounts = {
        "revenue": "revenue", "cost_of_sales": "cost_of_sales",
        "gross_profit": "coalesce(revenue, 0) - coalesce(cost_of_sales, 0)", "operating_expenses": "operating_expenses",
        "operating_income": "coalesce(revenue, 0) - coalesce(all_expenses, 0)", "other_income": "0", "other_expenses": "0",
        "net_income": "coalesce(revenue, 0) - coalesce(all_expenses, 0)",
    }
    body = f"""SELECT h.*, {_columns(amounts)}
  FROM ({_header(INCOME_TITLE, _period_dates(start, end), company)}) h
  LEFT JOIN (
    SELECT company_id, {_sum(_type(m.INCOME), 'revenue', credit=True)},
      {_sum(f"{expense} AND {_code(m.COST_OF_SALES_CODE)}", 'cost_of_sales')},
      {_sum(f"{expense} AND NOT {_code(m.COST_OF_SALES_CODE)}", 'operating_expenses')}, {_sum(expense, 'all_expenses')}
    FROM (
      SELECT company_id, account_id, sum(debit - credit) AS amount FROM {{p}}book_lines
      LEFT SEMI JOIN (SELECT id FROM {{p}}book_accounts WHERE {_type(m.INCOME, m.EXPENSE)}) a ON a.id = account_id
      LEFT SEMI JOIN (SELECT id FROM {{p}}book_moves WHERE state = 'posted') e ON e.id = move_id
      WHERE {_inside(start, end)} AND {_only(company)}
      GROUP BY company_id, account_id)
    JOIN {{p}}book_accounts ON id = account_id
    GROUP BY company_id) t ON t.company_id = h.company_id"""
    return _define("income_statement", _PERIOD, ["date_start", "date_end"], amounts, body)


def _balance() -> str:
    company, as_of, scope = _own("balance_sheet", "company", "as_of", "scope")
    asset, liability = _type(m.ASSET), _type(m.LIABILITY)
    sums = [
        _sum(f"{asset} AND {_code(m.CURRENT_ASSET_CODE)}", "current_assets"),
        _sum(f"{asset} AND {_code(m.NON_CURRENT_ASSET_CODE)}", "non_current_assets"),
        _sum(asset, "total_assets"),
        _sum(f"{liability} AND {_code(m.CURRENT_LIABILITY_CODE)}", "current_liabilities", credit=True),
        _sum(f"{liability} AND {_code(m.NON_CURRENT_LIABILITY_CODE)}", "non_current_liabilities", credit=True),
        _sum(liability, "total_liabilities", credit=True),
        _sum(_type(m.EQUITY), "total_equity", credit=True),
        _sum(_type(m.LIABILITY, m.EQUITY), "total_liabilities_equity", credit=True),
    ]
    amounts = {name: name for name in m.balance_measures()}
    # In the global scope all lines count for a company without number, and every company shows that one.
    body = f"""SELECT h.*, {_columns(amounts)}
  FROM ({_header(BALANCE_TITLE, f"coalesce({as_of}, current_date()) AS date", company)}) h
  LEFT JOIN (
    SELECT own, {', '.join(sums)}
    FROM (
      SELECT CASE {scope} WHEN 'company' THEN company_id WHEN 'global' THEN -1 END AS own, account_id, sum(debit - credit) AS amount
      FROM {{p}}book_lines WHERE {_POSTED} AND ({as_of} IS NULL OR date <= {as_of})
      GROUP BY own, account_id)
    JOIN {{p}}book_accounts ON id = account_id
    GROUP BY own) t ON t.own = CASE {scope} WHEN 'company' THEN h.company_id WHEN 'global' THEN -1 END"""
    parameters = {"company": "BIGINT DEFAULT NULL", "as_of": "DATE DEFAULT NULL", "scope": "STRING DEFAULT 'global'"}
    return _define("balance_sheet", parameters, ["date"], amounts, body)


def _cash_flow() -> str:
    company, start, end = _own("cash_flow", *_PERIOD)
    cash, bank = _code(m.CASH_CODE), _code(m.BANK_CODE)
    depreciation, provision, capital = _code(m.DEPRECIATION_CODE), _code(m.PROVISION_CODE), _code(m.CAPITAL_CODE)
    result = _type(m.INCOME, m.EXPENSE)
    undated = f"{start} IS NULL AND {end} IS NULL"
    amounts = {
        "net_income": "net_income", "adjustments": "adjustments", "cash_from_operations": "net_income",
        "capital_expenditure": "capital_expenditure", "cash_from_investing": "0", "debt_payments": "0", "equity_changes": "0",
        "cash_from_financing": "0", "net_change_cash": "net_change_cash", "beginning_cash": "beginning_cash",
        "ending_cash": f"CASE WHEN {undated} THEN net_change_cash ELSE coalesce(beginning_cash, 0) + coalesce(net_change_cash, 0) END",
    }
    # Each of the two branches is empty, and left out of the plan, where the other one is asked for.
    all_time = f"""SELECT -1 AS own, sum(net_income) AS net_income, sum(adjustments) AS adjustments,
        sum(capital_expenditure) AS capital_expenditure, sum(net_change_cash) AS net_change_cash,
        min_by(first_cash, CASE WHEN first_id IS NOT NULL THEN struct(date IS NULL AS undated, date) END) AS beginning_cash
      FROM (
        SELECT date, {_sum(f"{result} AND {_POSTED}", 'net_income', credit=True)},
          {_sum(f"{depreciation} OR {provision} AND {_POSTED}", 'adjustments')}, {_sum(f"{capital} AND {_POSTED}", 'capital_expenditure')},
          {_sum(f"{cash} OR {bank} AND {_POSTED}", 'net_change_cash')},
          min_by(amount, CASE WHEN ({cash} OR {bank}) AND {_POSTED} THEN line END) AS first_cash,
          min(CASE WHEN ({cash} OR {bank}) AND {_POSTED} THEN line END) AS first_id
        FROM (SELECT id AS line, account_id, date, parent_state, debit - credit AS amount FROM {{p}}book_lines)
        JOIN {{p}}book_accounts ON id = account_id
        WHERE {undated} AND ({' OR '.join([result, depreciation, provision, capital, cash, bank])})
        GROUP BY date)"""
    period = f"""SELECT company_id AS own, {_sum(result, 'net_income', credit=True)}, {_sum(f"{depreciation} OR {provision}", 'adjustments')},
        {_sum(capital, 'capital_expenditure')}, {_sum(f"{cash} OR {bank}", 'net_change_cash')},
        {_sum(f"{cash} OR {bank}", 'beginning_cash', amount='earlier')}
      FROM (
        SELECT company_id, account_id, sum(CASE WHEN inside THEN amount END) AS amount, sum(CASE WHEN NOT inside THEN amount END) AS earlier
        FROM (
          SELECT company_id, account_id, debit - credit AS amount, {start} IS NULL OR date >= {start} AS inside
          FROM {{p}}book_lines WHERE {_POSTED} AND date IS NOT NULL AND NOT ({undated}) AND ({end} IS NULL OR date <= {end})
            AND {_only(company)})
        GROUP BY company_id, account_id)
      JOIN {{p}}book_accounts ON id = account_id
      GROUP BY company_id"""
    body = f"""SELECT h.*, {_columns(amounts)}
  FROM ({_header(CASH_FLOW_TITLE, _period_dates(start, end), company)}) h
  LEFT JOIN ({all_time} UNION ALL {period}) t ON t.own = CASE WHEN {undated} THEN -1 ELSE h.company_id END"""
    return _define("cash_flow", _PERIOD, ["date_start", "date_end"], amounts, body)


def register_functions(books: Books, prefix: str = "") -> list[str]:
    """Define ``income_statement``, ``balance_sheet`` and ``cash_flow`` over these books in the session, with the
    views they read (``book_lines`` and so on) and the variable ``default_company``, null to begin with.
    """
    spark = books.spark
    accounts = books.accounts.select("id", "code", "internal_type")
    tables = {"lines": books.lines, "moves": books.moves, "accounts": accounts, "companies": books.companies}
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}book_{name}")
    spark.sql(f"DECLARE OR REPLACE VARIABLE {prefix}default_company BIGINT DEFAULT NULL")
    for definition in (_income(), _balance(), _cash_flow()):
        spark.sql(definition.replace("{p}", prefix))
    return [f"{prefix}{name}" for name in ("income_statement", "balance_sheet", "cash_flow")]
