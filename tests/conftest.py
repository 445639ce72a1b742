from __future__ import annotations

import os
import sys
from datetime import date
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerloom.plans.session import local_session  # noqa: E402
from ledgerloom.sources import schemas  # noqa: E402
from ledgerloom.sources.books import Books  # noqa: E402
from ledgerloom.sources.tpch import tpch_books  # noqa: E402

TESTDATA = os.environ.get("LEDGERLOOM_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = f"{TESTDATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path


@pytest.fixture(scope="session")
def tpch(spark, sf_dir):
    return tpch_books(spark, sf_dir)


DEFAULTS = {
    "lines": dict(move_id=1, account_id=1, partner_id=1, journal_id=1, company_id=1, date=date(2020, 1, 1),
                  ref=None, debit=Decimal(0), credit=Decimal(0), parent_state="posted",
                  analytic_account_id=None),
    "moves": dict(name="M", state="posted"),
    "accounts": dict(code=None, name="A", internal_type="asset", company_id=1, deprecated=False),
    "companies": dict(name="C", currency_id=1),
    "analytics": dict(code=None, name=None),
    "reports": dict(name="R", report_type="income", date_start=date(2020, 1, 1), date_end=date(2020, 12, 31),
                    company_ids=[1], analytic_account_ids=[], include_zero_lines=False, group_by_analytic=True),
}
SCHEMAS = {
    "lines": schemas.LINES, "moves": schemas.MOVES, "accounts": schemas.ACCOUNTS,
    "companies": schemas.COMPANIES, "analytics": schemas.ANALYTICS, "reports": schemas.REPORTS,
}


def frame(spark, kind, rows):
    """Rows given as dicts, the columns left out filled with the defaults of the table."""
    schema = SCHEMAS[kind]
    full = [{**DEFAULTS[kind], **row} for row in rows]
    for row in full:
        for money in ("debit", "credit"):
            if row.get(money) is not None and money in schema.names:
                row[money] = Decimal(str(row[money]))
    return spark.createDataFrame([tuple(row[n] for n in schema.names) for row in full], schema)


@pytest.fixture(scope="session")
def make_books(spark):
    def make(lines=(), moves=({"id": 1},), accounts=({"id": 1},), companies=({"id": 1},), analytics=()):
        tables = dict(lines=lines, moves=moves, accounts=accounts, companies=companies, analytics=analytics)
        return Books(**{kind: frame(spark, kind, rows) for kind, rows in tables.items()})
    return make


@pytest.fixture(scope="session")
def make_reports(spark):
    return lambda *rows: frame(spark, "reports", rows)
