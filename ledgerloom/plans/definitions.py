"""The batch of report definitions that the registered queries run on the journal."""

from __future__ import annotations

from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.schemas import REPORTS


def _year(first: int, last: int | None = None) -> tuple[date, date]:
    return date(first, 1, 1), date(last or first, 12, 31)


# (report_id, name, report_type, date_start, date_end, company_ids, analytic_account_ids,
#  include_zero_lines, group_by_analytic)
MIXED = [
    (1, "Income 1996", "income", *_year(1996), [1], [], False, True),
    (2, "Balance of two companies", "balance", *_year(1996, 2000), [2, 3], [], False, True),
    (3, "Cash of the group", "cashflow", *_year(1995, 2001), [1, 2, 3, 4, 5], [], False, False),
    (4, "Income 1997 with empty accounts", "income", *_year(1997), [4], [], True, False),
    (5, "Balance 1998 with zero groups", "balance", *_year(1998), [5], [], True, True),
    (6, "Income by two analytics, company named twice", "income", *_year(1996), [1, 1, 2], [1, 2], False, False),
    (7, "Cash of an empty period", "cashflow", *_year(1950), [1], [], True, False),
    (8, "Period that ends before it starts", "income", date(1998, 1, 1), date(1997, 1, 1), [2], [], True, True),
    (9, "Unknown type", "tax", *_year(1996), [1], [], True, False),
    (10, "Balance by two analytics", "balance", *_year(1996), [3], [2, 5], True, True),
    (11, "Empty period without zero lines", "income", *_year(1950), [1], [], False, False),
]


def of_type(report_type: str) -> list[tuple]:
    """A report per company of one type, grouped by analytic account."""
    return [
        (company, f"{report_type} of company {company}", report_type, *_year(1996, 1997), [company], [], False, True)
        for company in range(1, 6)
    ]


FLAT = [
    (1, "Income, all companies", "income", *_year(1996), [1, 2, 3, 4, 5], [], False, False),
    (2, "Balance, all companies", "balance", *_year(1996), [1, 2, 3, 4, 5], [], False, False),
]
ZERO = [
    (1, "Flat, with zero lines", "income", *_year(1996), [1, 2, 3, 4, 5], [], True, False),
    (2, "Grouped, with zero lines", "income", *_year(1996), [1, 2, 3, 4, 5], [], True, True),
]
ANALYTIC = [
    (1, "One analytic account", "income", *_year(1996, 1998), [1, 2, 3, 4, 5], [3], False, True),
    (2, "Two analytic accounts, flat", "balance", *_year(1996, 1998), [1, 2, 3, 4, 5], [1, 6], True, False),
    (3, "All analytic accounts", "cashflow", *_year(1996, 1998), [1, 2, 3, 4, 5], [], False, True),
]
# Periods far apart, with years in between that no report asks for.
SPARSE = [
    (1, "Early income", "income", date(1995, 2, 10), date(1995, 4, 5), [1, 2, 3, 4, 5], [], False, True),
    (2, "Late balance", "balance", date(1998, 3, 1), date(1998, 3, 31), [2, 4], [], True, False),
    (3, "Late cash", "cashflow", date(1998, 3, 20), date(1998, 5, 2), [1, 3], [], False, True),
    (4, "Period that ends before it starts", "income", date(1997, 5, 1), date(1996, 1, 1), [1], [], True, False),
]
STORED = [one for one in MIXED if one[2] != "tax"]
# The same reports after a change: 1 and 4 move, 2 becomes empty, 5 gets an unknown type.
CHANGED = {1: ("income", *_year(1997)), 2: ("balance", *_year(1950)), 4: ("income", *_year(1998)), 5: ("tax", *_year(1998))}
REFRESHED = [
    (*one[:2], *CHANGED[one[0]], *one[5:]) if one[0] in CHANGED else one for one in STORED
]


def definitions(spark: SparkSession, batch: list[tuple]) -> DataFrame:
    """The batch as a local relation: its size is known to the planner."""
    columns = dict(zip(REPORTS.names, map(list, zip(*batch))))
    ids = {name: pa.array(columns[name], pa.list_(pa.int64())) for name in ("company_ids", "analytic_account_ids")}
    return spark.createDataFrame(pa.table({**columns, **ids}), REPORTS)


def definitions_sql(batch: list[tuple]) -> str:
    """The batch as a SQL ``VALUES`` list with the same columns."""

    def literal(value) -> str:
        if isinstance(value, bool):
            return str(value).upper()
        if isinstance(value, int):
            return str(value)
        if isinstance(value, date):
            return f"DATE '{value}'"
        if isinstance(value, list):
            return f"CAST([{', '.join(map(str, value))}] AS BIGINT[])"
        return "'" + value.replace("'", "''") + "'"

    rows = ",\n    ".join("(" + ", ".join(literal(v) for v in one) + ")" for one in batch)
    return f"SELECT * REPLACE (CAST(report_id AS BIGINT) AS report_id) FROM (VALUES\n    {rows}\n  ) AS v ({', '.join(REPORTS.names)})"
