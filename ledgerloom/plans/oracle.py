"""DuckDB SQL for each registered query, on the views of the given tables.

The SQL is written independently of the DataFrame code: line-level joins and plain
windows where Spark works on subtotals.
"""

from __future__ import annotations

from ledgerloom.plans import definitions as d
from ledgerloom.plans.catalog import (
    ANALYTIC_CODES, AS_OF, HOT_ACCOUNT, HOT_DAY, LATER_PERIOD, PAGE, PAGE_NUMBER, PERIOD, TODAY,
)

# Titles and column lists, as literals of their own, so that they check those of the library.
INCOME_TITLE = "Estado de Resultados - "
BALANCE_TITLE = "Balance General - "
CASH_FLOW_TITLE = "Flujo de Caja - "
UNNAMED_COMPANY = "Compañía"
BASE_COLUMNS = ("id, date, move_id, move_name, account_id, partner_id, journal_id, ref, debit, credit,"
                " company_currency_id")
LIST_COLUMNS = "date, move_name, account_id, journal_id, partner_id, ref, debit, credit, balance"
INCOME_LIST = "name, date_start, date_end, revenue, cost_of_sales, gross_profit, operating_income, net_income"
BALANCE_LIST = "name, date, total_assets, total_liabilities, total_equity, total_liabilities_equity"
CASH_FLOW_LIST = ("name, date_start, date_end, cash_from_operations, cash_from_investing, cash_from_financing,"
                  " net_change_cash, ending_cash")

BOOKS = """
res_company AS (
  SELECT CAST(r_regionkey + 1 AS BIGINT) AS id,
         CASE WHEN r_regionkey = 2 THEN NULL ELSE r_name END AS name,
         CAST(r_regionkey % 2 + 1 AS BIGINT) AS currency_id
  FROM region),
account_account AS (
  SELECT p_partkey + 1 AS id,
         CASE p_partkey % 16
           WHEN 0 THEN '1011' WHEN 1 THEN '1012' WHEN 2 THEN '12' WHEN 3 THEN '16' WHEN 4 THEN '3'
           WHEN 5 THEN '20' WHEN 6 THEN '27' WHEN 7 THEN '4' WHEN 8 THEN '50' WHEN 9 THEN '70'
           WHEN 10 THEN '75' WHEN 11 THEN '51' WHEN 12 THEN '60' WHEN 13 THEN '681' WHEN 14 THEN '682'
         END || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS code,
         p_name AS name,
         CASE WHEN p_partkey % 16 < 5 THEN 'asset' WHEN p_partkey % 16 < 8 THEN 'liability'
              WHEN p_partkey % 16 = 8 THEN 'equity' WHEN p_partkey % 16 < 11 THEN 'income'
              ELSE 'expense' END AS internal_type,
         CAST(CAST(floor(p_partkey / 16) AS BIGINT) % 5 + 1 AS BIGINT) AS company_id,
         p_partkey % 11 = 0 AS deprecated
  FROM part),
account_move AS (
  SELECT o_orderkey + 1 AS id, 'MOVE/' || CAST(o_orderkey + 1 AS VARCHAR) AS name,
         CASE o_orderstatus WHEN 'O' THEN 'draft' ELSE 'posted' END AS state
  FROM orders),
item AS (
  SELECT *, row_number() OVER (
    PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity,
             l_discount, l_tax, l_returnflag, l_linestatus) AS rn
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
account_move_line AS (
  SELECT CAST(l_orderkey * 1048576 + rn * 2 + side AS BIGINT) AS id,
         l_orderkey + 1 AS move_id,
         CAST(CASE WHEN side = 0 OR l_linenumber = 7 THEN l_partkey + 1
                   ELSE (l_partkey * 7 + l_suppkey) % 200 + 1 END AS BIGINT) AS account_id,
         o_custkey + 1 AS partner_id,
         CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS journal_id,
         CAST(o_custkey % 5 + 1 AS BIGINT) AS company_id,
         CASE WHEN l_quantity = 13 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date,
         l_returnflag || l_linestatus AS ref,
         CAST(CASE WHEN side = 0 THEN l_extendedprice ELSE 0 END AS DECIMAL(15,2)) AS debit,
         CAST(CASE WHEN side = 1 THEN l_extendedprice ELSE 0 END AS DECIMAL(15,2)) AS credit,
         CASE o_orderstatus WHEN 'O' THEN 'draft' ELSE 'posted' END AS parent_state,
         CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber = 5 THEN CAST(l_suppkey + 1000000001 AS BIGINT)
              ELSE CAST(l_suppkey + 1 AS BIGINT) END AS analytic_account_id
  FROM item, (VALUES (0), (1)) AS sides (side)),
account_analytic_account AS (
  SELECT CAST(s_suppkey + 1 AS BIGINT) AS id,
         'AN' || lpad(CAST(s_suppkey + 1 AS VARCHAR), 9, '0') AS code, s_name AS name
  FROM supplier)"""

LEDGER = """
ledger AS (
  SELECT l.id, l.date, l.move_id, m.name AS move_name, l.account_id, l.partner_id, l.journal_id,
         l.ref, l.debit, l.credit,
         CAST(sum(l.debit - l.credit) OVER (
           PARTITION BY l.account_id ORDER BY l.date NULLS LAST, l.id) AS DECIMAL(28,2)) AS balance,
         c.currency_id AS company_currency_id
  FROM account_move_line l
  JOIN account_move m ON m.id = l.move_id
  JOIN res_company c ON c.id = l.company_id
  WHERE l.parent_state = 'posted')"""

HOT_LINES = f"""
hot_line AS (
  SELECT * REPLACE (
    CAST(CASE WHEN id % 3 = 0 THEN {HOT_ACCOUNT} ELSE account_id END AS BIGINT) AS account_id,
    CASE WHEN id % 3 = 0 THEN DATE '{HOT_DAY}' ELSE date END AS date)
  FROM account_move_line)"""

GAPS = """
gap_line AS (
  SELECT * REPLACE (
    CASE WHEN id % 13 <> 3 THEN move_id WHEN id % 2 = 0 THEN -1 END AS move_id,
    CASE WHEN id % 11 <> 5 THEN company_id WHEN id % 2 = 0 THEN -1 END AS company_id)
  FROM account_move_line)"""


def _sql(body: str, *ctes: str) -> str:
    return "WITH" + ",".join([BOOKS, *ctes]) + "\n" + body


def _money(expression: str, name: str) -> str:
    return f"CAST(coalesce({expression}, 0) AS DECIMAL(28,2)) AS {name}"


def _ledger(body: str) -> str:
    return _sql(body, LEDGER)


def _groups(by: str) -> str:
    return _ledger(f"""SELECT {by}, CAST(sum(debit) AS DECIMAL(28,2)) AS debit,
  CAST(sum(credit) AS DECIMAL(28,2)) AS credit, count(*) AS line_count
FROM ledger GROUP BY {by}""")


def _level(keys: str, level: int, others: str = "") -> str:
    """One level of nested groups, the keys of deeper levels as nulls."""
    columns = ", ".join(part for part in (keys, others or ("" if keys else "NULL AS partner_id")) if part)
    return f"""SELECT {columns}, CAST({level} AS BIGINT) AS level, CAST(sum(debit) AS DECIMAL(28,2)) AS debit,
  CAST(sum(credit) AS DECIMAL(28,2)) AS credit, count(*) AS line_count
FROM ledger {f"GROUP BY {keys}" if keys else ""}"""


def _header(title: str, dates: str) -> str:
    return f"""row_number() OVER (ORDER BY c.id) AS id,
  '{title}' || coalesce(c.name, '{UNNAMED_COMPANY}') AS name, {dates},
  c.id AS company_id, c.currency_id"""


def _total(side: str, condition: str, company: bool, extra: str = "") -> str:
    """A scalar subquery: the sum of one side over the lines that satisfy ``condition``."""
    amount = "l.debit - l.credit" if side == "debit" else "l.credit - l.debit"
    own = " AND l.company_id = c.id" if company else ""
    return (
        f"coalesce((SELECT sum({amount}) FROM account_move_line l JOIN account_account a"
        f" ON a.id = l.account_id {extra} WHERE ({condition}){own}), 0)"
    )


def _income(period: tuple[str, str] | None = None) -> str:
    dated = f" AND l.date BETWEEN DATE '{period[0]}' AND DATE '{period[1]}'" if period else ""
    entry = "JOIN account_move m ON m.id = l.move_id"

    def total(side: str, condition: str) -> str:
        return _total(side, f"{condition} AND m.state = 'posted'{dated}", True, entry)

    revenue = total("credit", "a.internal_type = 'income'")
    cost = total("debit", "a.internal_type = 'expense' AND a.code LIKE '5%'")
    other = total("debit", "a.internal_type = 'expense' AND a.code NOT LIKE '5%'")
    expenses = total("debit", "a.internal_type = 'expense'")
    start, end = period or (TODAY, TODAY)
    return _sql(f"""SELECT {_header(INCOME_TITLE, f"DATE '{start}' AS date_start, DATE '{end}' AS date_end")},
  {_money(revenue, 'revenue')}, {_money(cost, 'cost_of_sales')},
  {_money(f'{revenue} - {cost}', 'gross_profit')}, {_money(other, 'operating_expenses')},
  {_money(f'{revenue} - {expenses}', 'operating_income')},
  {_money('0', 'other_income')}, {_money('0', 'other_expenses')},
  {_money(f'{revenue} - {expenses}', 'net_income')}
FROM res_company c""")


def _balance(as_of: str | None = None) -> str:
    dated = f" AND l.date <= DATE '{as_of}'" if as_of else ""

    def total(side: str, condition: str) -> str:
        return _total(side, f"{condition} AND l.parent_state = 'posted'{dated}", as_of is not None)

    measures = [
        ("debit", "a.internal_type = 'asset' AND a.code LIKE '1%'", "current_assets"),
        ("debit", "a.internal_type = 'asset' AND a.code LIKE '16%'", "non_current_assets"),
        ("debit", "a.internal_type = 'asset'", "total_assets"),
        ("credit", "a.internal_type = 'liability' AND a.code LIKE '2%'", "current_liabilities"),
        ("credit", "a.internal_type = 'liability' AND a.code LIKE '27%'", "non_current_liabilities"),
        ("credit", "a.internal_type = 'liability'", "total_liabilities"),
        ("credit", "a.internal_type = 'equity'", "total_equity"),
        ("credit", "a.internal_type IN ('liability', 'equity')", "total_liabilities_equity"),
    ]
    columns = ",\n  ".join(_money(total(side, condition), name) for side, condition, name in measures)
    header = _header(BALANCE_TITLE, f"DATE '{as_of or TODAY}' AS date")
    return _sql(f"SELECT {header},\n  {columns}\nFROM res_company c")


def _check(company: bool) -> str:
    def total(side: str, types: str) -> str:
        return _total(side, f"a.internal_type IN ({types}) AND l.parent_state = 'posted'", company)

    assets = total("debit", "'asset'")
    claims = total("credit", "'liability', 'equity'")
    result = f"({total('credit', repr('income'))} - {total('debit', repr('expense'))})"
    return _sql(f"""SELECT c.id AS company_id, c.currency_id,
  {_money(assets, 'total_assets')}, {_money(claims, 'total_liabilities_equity')},
  {_money(f'{assets} - {claims}', 'difference')}, {_money(result, 'period_result')},
  {_money(f'{assets} - {claims} - {result}', 'unexplained')}
FROM res_company c""")


def _cash_columns(net, adjustments, capital, change, beginning, ending) -> str:
    return ",\n  ".join([
        _money(net, "net_income"), _money(adjustments, "adjustments"), _money(net, "cash_from_operations"),
        _money(capital, "capital_expenditure"),
        *[_money("0", name) for name in
          ("cash_from_investing", "debt_payments", "equity_changes", "cash_from_financing")],
        _money(change, "net_change_cash"), _money(beginning, "beginning_cash"), _money(ending, "ending_cash"),
    ])


def _cash_flow(company: bool = False) -> str:
    posted = "l.parent_state = 'posted'"
    net = (
        f"({_total('credit', f'{posted} AND a.internal_type = ' + repr('income'), company)}"
        f" - {_total('debit', f'{posted} AND a.internal_type = ' + repr('expense'), company)})"
    )
    change = _total("debit", f"a.code LIKE '1011%' OR (a.code LIKE '1012%' AND {posted})", company)
    own = " AND l.company_id = c.id" if company else ""
    first = f"""(SELECT l.debit - l.credit FROM account_move_line l
      JOIN account_account a ON a.id = l.account_id
      WHERE (a.code LIKE '1011%' OR a.code LIKE '1012%') AND {posted}{own}
      ORDER BY l.date NULLS LAST, l.id LIMIT 1)"""
    columns = _cash_columns(
        net,
        _total("debit", f"a.code LIKE '681%' OR (a.code LIKE '682%' AND {posted})", company),
        _total("debit", f"a.code LIKE '16%' AND {posted}", company),
        change, first, change,
    )
    header = _header(CASH_FLOW_TITLE, f"DATE '{TODAY}' AS date_start, DATE '{TODAY}' AS date_end")
    return _sql(f"SELECT {header},\n  {columns}\nFROM res_company c")


def _cash_flow_period() -> str:
    start, end = PERIOD
    during = f"l.parent_state = 'posted' AND l.date BETWEEN DATE '{start}' AND DATE '{end}'"
    before = f"l.parent_state = 'posted' AND l.date < DATE '{start}'"
    cash = "(a.code LIKE '1011%' OR a.code LIKE '1012%')"
    net = (
        f"({_total('credit', f'{during} AND a.internal_type = ' + repr('income'), True)}"
        f" - {_total('debit', f'{during} AND a.internal_type = ' + repr('expense'), True)})"
    )
    change = _total("debit", f"{during} AND {cash}", True)
    opening = _total("debit", f"{before} AND {cash}", True)
    columns = _cash_columns(
        net,
        _total("debit", f"{during} AND (a.code LIKE '681%' OR a.code LIKE '682%')", True),
        _total("debit", f"{during} AND a.code LIKE '16%'", True),
        change, opening, f"{opening} + {change}",
    )
    header = _header(CASH_FLOW_TITLE, f"DATE '{start}' AS date_start, DATE '{end}' AS date_end")
    return _sql(f"SELECT {header},\n  {columns}\nFROM res_company c")


def _list(statement: str, columns: str) -> str:
    return f"SELECT {columns} FROM (\n{statement}\n) AS statement"


def _report_ctes(batch: list[tuple]) -> list[str]:
    return [
        f"""
report_definition AS (
  {d.definitions_sql(batch)})""",
        """
asked AS (
  SELECT r.*, a.id AS account_id, a.code, a.name AS account_name, a.internal_type, a.company_id
  FROM report_definition r
  JOIN account_account a ON list_contains(r.company_ids, a.company_id) AND NOT a.deprecated
  WHERE CASE r.report_type
          WHEN 'income' THEN a.internal_type IN ('income', 'expense')
          WHEN 'balance' THEN a.internal_type IN ('asset', 'liability', 'equity')
          WHEN 'cashflow' THEN a.code LIKE '101%'
          ELSE FALSE END)""",
        """
movement AS (
  SELECT q.report_id, q.account_id, l.debit, l.credit,
         CASE WHEN q.group_by_analytic THEN coalesce(l.analytic_account_id, 0) ELSE 0 END AS analytic
  FROM asked q
  JOIN account_move_line l ON l.account_id = q.account_id AND l.company_id = q.company_id
   AND l.parent_state = 'posted' AND l.date >= q.date_start AND l.date <= q.date_end
  WHERE len(q.analytic_account_ids) = 0 OR list_contains(q.analytic_account_ids, l.analytic_account_id))""",
        """
amounts AS (
  SELECT report_id, account_id, analytic, sum(debit) AS debit, sum(credit) AS credit
  FROM movement GROUP BY report_id, account_id, analytic
  UNION ALL
  SELECT q.report_id, q.account_id, 0, 0, 0 FROM asked q
  WHERE NOT q.group_by_analytic AND q.include_zero_lines AND NOT EXISTS (
    SELECT 1 FROM movement v WHERE v.report_id = q.report_id AND v.account_id = q.account_id))""",
        """
report_line AS (
  SELECT q.report_id, q.company_id, q.report_type, q.date_start, q.date_end, q.account_id,
         q.code AS account_code, q.account_name, q.internal_type AS account_type,
         CAST(nullif(s.analytic, 0) AS BIGINT) AS analytic_account_id,
         CASE WHEN s.analytic = 0 THEN 'SIN ANALÍTICA' ELSE n.code END AS analytic_code,
         CASE WHEN s.analytic = 0 THEN 'Sin Cuenta Analítica' ELSE n.name END AS analytic_name,
         CAST(s.debit AS DECIMAL(28,2)) AS debit, CAST(s.credit AS DECIMAL(28,2)) AS credit,
         CAST(s.debit - s.credit AS DECIMAL(28,2)) AS balance, c.currency_id,
         CASE WHEN s.debit < s.credit THEN 'red' ELSE 'black' END AS balance_color
  FROM amounts s
  JOIN asked q ON q.report_id = s.report_id AND q.account_id = s.account_id
  LEFT JOIN account_analytic_account n ON n.id = s.analytic
  LEFT JOIN res_company c ON c.id = q.company_id
  WHERE q.include_zero_lines OR s.debit <> s.credit)""",
    ]


def _report(batch: list[tuple]) -> str:
    return _sql("SELECT * FROM report_line", *_report_ctes(batch))


def _report_totals() -> str:
    sums = ", ".join(_money(f"sum({c})", f"total_{c}") for c in ("debit", "credit", "balance"))
    return _sql(f"""SELECT r.report_id, {sums}
FROM report_definition r LEFT JOIN report_line l ON l.report_id = r.report_id
GROUP BY r.report_id""", *_report_ctes(d.MIXED))


def _report_headers() -> str:
    sums = ", ".join(_money(f"sum(l.{c})", f"total_{c}") for c in ("debit", "credit", "balance"))
    return _sql(f"""SELECT r.report_id, r.name, r.report_type, r.date_start, r.date_end, {sums}
FROM report_definition r LEFT JOIN report_line l ON l.report_id = r.report_id
GROUP BY ALL""", *_report_ctes(d.REFRESHED))


VALIDATION = """
WITH request AS (
  SELECT c_custkey + 1 AS report_id,
         CASE WHEN c_custkey % 13 <> 0 THEN c_name END AS name,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'income' WHEN 'FURNITURE' THEN 'balance'
           WHEN 'MACHINERY' THEN 'cashflow' WHEN 'AUTOMOBILE' THEN 'tax' END AS report_type,
         CASE WHEN c_nationkey <> 3 THEN make_date(1994 + c_custkey % 5, 1, 1) END AS date_start,
         CASE WHEN c_nationkey <> 4 THEN DATE '1999-12-31' END AS date_end,
         c_custkey % 17 = 0 OR c_custkey % 19 = 0 AS no_company
  FROM customer)
SELECT report_id, name, report_type, date_start, date_end,
  concat_ws(', ',
    CASE WHEN name IS NULL THEN 'name' END,
    CASE WHEN report_type IS NULL OR report_type NOT IN ('income', 'balance', 'cashflow')
         THEN 'report_type' END,
    CASE WHEN date_start IS NULL THEN 'date_start' END,
    CASE WHEN date_end IS NULL THEN 'date_end' END,
    CASE WHEN no_company THEN 'company_ids' END) AS problems
FROM request"""

BALANCES = """
label AS (
  SELECT id, CASE WHEN code IS NULL THEN '#' || id
    WHEN code LIKE '%#%' OR (SELECT count(*) FROM account_analytic_account o WHERE o.code = n.code) > 1
    THEN code || '#' || id ELSE code END AS code
  FROM account_analytic_account n),
by_code AS (
  SELECT l.company_id, l.account_id, l.analytic_account_id AS analytic,
    coalesce(n.code, '#' || l.analytic_account_id) AS code, sum(l.debit - l.credit) AS balance
  FROM account_move_line l LEFT JOIN label n ON n.id = l.analytic_account_id
  WHERE l.parent_state = 'posted'
  GROUP BY l.company_id, l.account_id, l.analytic_account_id, n.code)"""


def _pivot(columns: str) -> str:
    return _sql(f"""SELECT a.id AS account_id, a.code AS account_code, a.name AS account_name, b.company_id,
  {columns},
  {_money('sum(b.balance) FILTER (WHERE b.analytic IS NULL)', 'balance_without_analytic')},
  {_money('sum(b.balance)', 'total_balance')}, c.currency_id
FROM by_code b
JOIN account_account a ON a.id = b.account_id
JOIN res_company c ON c.id = b.company_id
GROUP BY a.id, a.code, a.name, b.company_id, c.currency_id
ORDER BY a.code NULLS LAST, b.company_id, a.name NULLS LAST""", BALANCES)


PIVOT_JSON = """'{' || coalesce(string_agg(
    '"' || b.code || '":' || CAST(CAST(b.balance AS DECIMAL(28,2)) AS VARCHAR), ',' ORDER BY b.code)
    FILTER (WHERE b.code IS NOT NULL), '') || '}' AS analytic_data"""
PIVOT_COLUMNS = ",\n  ".join(
    f"CAST(sum(b.balance) FILTER (WHERE b.code = '{code}') AS DECIMAL(28,2)) AS {code}"
    for code in ANALYTIC_CODES
)

PIVOT_ALL = _sql(f"""SELECT a.id AS account_id, a.code AS account_code, a.name AS account_name, t.company_id,
  p.* EXCLUDE (account_id, company_id), t.balance_without_analytic, t.total_balance, c.currency_id
FROM (
  SELECT account_id, company_id, {_money('sum(balance) FILTER (WHERE analytic IS NULL)', 'balance_without_analytic')},
    {_money('sum(balance)', 'total_balance')}
  FROM by_code GROUP BY account_id, company_id) t
JOIN account_account a ON a.id = t.account_id
JOIN res_company c ON c.id = t.company_id
LEFT JOIN (PIVOT coded ON code USING any_value(amount) GROUP BY account_id, company_id) p
  ON p.account_id = t.account_id AND p.company_id = t.company_id""", BALANCES, """
coded AS (
  SELECT account_id, company_id, code, CAST(sum(balance) AS DECIMAL(28,2)) AS amount
  FROM by_code WHERE code IS NOT NULL GROUP BY account_id, company_id, code)""")

ORACLE: dict[str, str] = {
    "ledger_base": _ledger(f"SELECT {BASE_COLUMNS} FROM ledger"),
    "general_ledger": _ledger("SELECT * FROM ledger"),
    "general_ledger_bucketed": _sql(
        "SELECT * FROM ledger", HOT_LINES, LEDGER.replace("account_move_line", "hot_line")
    ),
    "ledger_list": _ledger(f"SELECT {LIST_COLUMNS} FROM ledger"),
    "ledger_first_page": _ledger(
        f"SELECT * FROM ledger ORDER BY account_id NULLS LAST, date NULLS LAST, id LIMIT {PAGE}"
    ),
    "ledger_between": _ledger(
        f"SELECT * FROM ledger WHERE date >= DATE '{PERIOD[0]}' AND date <= DATE '{PERIOD[1]}'"
    ),
    "ledger_search": _ledger("SELECT * FROM ledger WHERE journal_id = 3 AND ref ILIKE '%n%'"),
    "ledger_search_account": _ledger("SELECT * FROM ledger WHERE account_id = 7"),
    "ledger_search_entry": _ledger("SELECT * FROM ledger WHERE move_name ILIKE '%move/7%'"),
    "ledger_search_indexed": _ledger("SELECT * FROM ledger WHERE move_name ILIKE '%move/77%'"),
    "ledger_search_indexed_ref": _ledger("SELECT * FROM ledger WHERE journal_id = 3 AND ref ILIKE '%n%'"),
    "ledger_by_account": _groups("account_id"),
    "ledger_by_journal": _groups("journal_id"),
    "ledger_by_partner": _groups("partner_id"),
    "ledger_rollup": _ledger("\nUNION ALL\n".join([_level("partner_id", 1), _level("", 0)])),
    "ledger_nested_groups": _ledger("\nUNION ALL\n".join(
        [_level("account_id, journal_id", 2), _level("account_id", 1, "NULL AS journal_id"),
         _level("", 0, "NULL AS account_id, NULL AS journal_id")]
    )),
    "ledger_drill_through": _sql("""SELECT * FROM account_move_line WHERE move_id IN (
  SELECT l.move_id FROM account_move_line l
  JOIN account_move m ON m.id = l.move_id JOIN res_company c ON c.id = l.company_id
  WHERE l.parent_state = 'posted' AND l.ref = 'RF')
ORDER BY id"""),
    "ledger_views": _ledger("""SELECT account_id, count(*) AS line_count, CAST(sum(debit) AS DECIMAL(28,2)) AS debit,
  last(balance ORDER BY date NULLS LAST, id) AS last_balance, CAST(sum(balance) AS DECIMAL(38,2)) AS balances
FROM ledger GROUP BY account_id"""),
    "income_view": _income(),
    "balance_view": _balance(),
    "cash_flow_view": _cash_flow(),
    "report_lines_view": _report(d.FLAT),
    "report_pivot_view": f"SELECT account_id, company_id, analytic_data, total_balance FROM ({_pivot(PIVOT_JSON)}) AS p",
    "ledger_with_gaps": _sql("SELECT * FROM ledger", GAPS, LEDGER.replace("account_move_line", "gap_line")),
    "ledger_groups_with_gaps": _sql("""SELECT account_id, CAST(sum(debit) AS DECIMAL(28,2)) AS debit,
  CAST(sum(credit) AS DECIMAL(28,2)) AS credit, count(*) AS line_count
FROM ledger GROUP BY account_id""", GAPS, LEDGER.replace("account_move_line", "gap_line")),
    "balance_sheet_with_gaps": _balance(),
    "income_statement_with_gaps": _income().replace("WITH" + BOOKS, "WITH" + BOOKS + "," + GAPS)
    .replace("(SELECT sum(l.credit - l.debit) FROM account_move_line l", "(SELECT sum(l.credit - l.debit) FROM gap_line l")
    .replace("(SELECT sum(l.debit - l.credit) FROM account_move_line l", "(SELECT sum(l.debit - l.credit) FROM gap_line l"),
    "ledger_between_stored_balances": _ledger(
        f"SELECT * FROM ledger WHERE date >= DATE '{PERIOD[0]}' AND date <= DATE '{PERIOD[1]}'"
    ),
    "ledger_between_folded_balances": _ledger(
        f"SELECT * FROM ledger WHERE date >= DATE '{LATER_PERIOD[0]}' AND date <= DATE '{LATER_PERIOD[1]}'"
    ),
    "ledger_next_page": _ledger(
        f"""SELECT * FROM ledger WHERE account_id > 7
   OR (account_id = 7 AND (date IS NULL OR date > DATE '{AS_OF}' OR (date = DATE '{AS_OF}' AND id > 0)))
ORDER BY account_id NULLS LAST, date NULLS LAST, id LIMIT {PAGE}"""
    ),
    "ledger_page_stored": _ledger(
        f"SELECT * FROM ledger ORDER BY account_id NULLS LAST, date NULLS LAST, id LIMIT {PAGE} OFFSET {PAGE * PAGE_NUMBER}"
    ),
    "ledger_page_on_hot_day": _sql(f"""SELECT * FROM ledger WHERE account_id > {HOT_ACCOUNT}
   OR (account_id = {HOT_ACCOUNT} AND (date IS NULL OR date >= DATE '{HOT_DAY}'))
ORDER BY account_id NULLS LAST, date NULLS LAST, id LIMIT {PAGE}""", HOT_LINES, LEDGER.replace("account_move_line", "hot_line")),
    "ledger_search_account_text": _ledger("""SELECT ledger.* FROM ledger JOIN account_account a ON a.id = account_id
WHERE a.code ILIKE '%10110000%' OR a.name ILIKE '%10110000%'"""),
    "income_statement": _income(),
    "income_statement_period": _income(PERIOD),
    "income_statement_list": _list(_income(), INCOME_LIST),
    "balance_sheet": _balance(),
    "balance_sheet_as_of": _balance(AS_OF),
    "balance_sheet_list": _list(_balance(), BALANCE_LIST),
    "balance_check": _check(company=False),
    "balance_check_by_company": _check(company=True),
    "cash_flow": _cash_flow(),
    "cash_flow_by_company": _cash_flow(company=True),
    "income_statement_of_company": f"SELECT * FROM ({_income()}) AS s WHERE company_id = 3",
    "balance_sheet_of_company": f"SELECT * FROM ({_balance()}) AS s WHERE company_id = 3",
    "cash_flow_of_company": f"SELECT * FROM ({_cash_flow(company=True)}) AS s WHERE company_id = 3",
    "cash_flow_period": _cash_flow_period(),
    "cash_flow_list": _list(_cash_flow(), CASH_FLOW_LIST),
    "income_statement_function": _income(PERIOD),
    "balance_sheet_function": _balance(AS_OF),
    "cash_flow_function": f"SELECT * FROM ({_cash_flow_period()}) AS s WHERE company_id = 3",
    "report_validation": VALIDATION,
    "report_lines": _report(d.MIXED),
    "report_income": _report(d.of_type("income")),
    "report_balance": _report(d.of_type("balance")),
    "report_cashflow": _report(d.of_type("cashflow")),
    "report_lines_flat": _report(d.FLAT),
    "report_lines_zero": _report(d.ZERO),
    "report_lines_analytic_filter": _report(d.ANALYTIC),
    "report_lines_sparse": _report(d.SPARSE),
    "report_totals": _report_totals(),
    "report_store": _report(d.MIXED),
    "report_refresh": _report(d.REFRESHED),
    "report_headers": _report_headers(),
    "report_refresh_touched": _report(d.STORED),
    "report_store_views": _sql(f"""SELECT r.report_id, r.name, {_money('sum(l.balance)', 'total_balance')},
  count(l.account_id) AS line_count, {_money('sum(l.balance)', 'line_balance')}
FROM report_definition r LEFT JOIN report_line l ON l.report_id = r.report_id
GROUP BY ALL""", *_report_ctes(d.REFRESHED)),
    "report_lines_from_files": _report(d.MIXED),
    "report_pivot_json": _pivot(PIVOT_JSON),
    "report_pivot": _pivot(PIVOT_COLUMNS),
    "report_pivot_all_labels": PIVOT_ALL,
    "report_pivot_variant": _pivot(PIVOT_COLUMNS),
    "balance_sheet_observed": f"""SELECT total_assets AS sheet_assets, total_liabilities_equity AS sheet_claims, lines,
  total_assets, total_liabilities_equity, difference, period_result, unexplained
FROM ({_check(company=False)} LIMIT 1) AS c, (
  {_sql("SELECT count(*) AS lines FROM account_move_line l JOIN account_account a ON a.id = l.account_id WHERE l.parent_state = 'posted'")}) AS n""",
}
