"""Checks made on the way, and pivots that keep their types."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import Observation, functions as F

from ledgerloom.operators import pivot, statements

ACCOUNTS = [dict(id=1, internal_type="asset"), dict(id=2, internal_type="liability"), dict(id=3, internal_type="income"), dict(id=4, internal_type="expense")]


def test_observed_figures_are_those_of_the_check(make_books, tmp_path):
    scope = "company"
    lines = [dict(id=i, account_id=1 + i % 4, debit=i * 3 % 7, credit=i % 5, company_id=1 + i % 2, parent_state=["posted", "draft"][i % 9 == 0])
             for i in range(40)] + [dict(id=99, account_id=1, debit="0.01"), dict(id=100, account_id=77, debit=5)]
    books = make_books(lines=lines, accounts=ACCOUNTS, companies=[dict(id=1), dict(id=2)])
    seen = Observation("balance")
    sheet = statements.balance_sheet(books, scope=scope, observation=seen)
    sheet.write.parquet(str(tmp_path / scope))
    check = statements.balance_check(books).first()
    assert {k: v for k, v in seen.get.items() if k != "lines"} == {
        k: check[k] for k in ("total_assets", "total_liabilities_equity", "difference", "period_result", "unexplained")
    }
    assert check.unexplained != 0 and seen.get["lines"] == sum(i % 9 != 0 for i in range(40)) + 1
    plain = statements.balance_sheet(books, scope=scope)
    assert sheet.columns == plain.columns and sorted(map(str, sheet.collect())) == sorted(map(str, plain.collect()))
    text = sheet._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("CollectMetrics") == 1  # the same pass


def test_a_global_sheet_is_not_observed(make_books):
    with pytest.raises(ValueError):
        statements.balance_sheet(make_books(), observation=Observation("balance"))


def test_variant_keeps_labels_and_amounts(make_books, tmp_path):
    labels = ["AN'1", "a b", "x.y", "#", None]
    analytics = [dict(id=i, code=c) for i, c in enumerate(labels, 1)]
    lines = [dict(id=i, account_id=1, debit=f"{10**12 + i}.{i:02d}", analytic_account_id=i % 7 or None) for i in range(14)]
    books = make_books(lines=lines, analytics=analytics)
    made = pivot.report_pivot_variant(books)
    made.write.parquet(str(tmp_path / "pivot"))
    stored = made.sparkSession.read.parquet(str(tmp_path / "pivot"))
    known = {r.label for r in pivot.analytic_labels(books).collect()} | {"#6"}
    plain = pivot.report_pivot(books, sorted(known)).first().asDict()
    row = stored.select(*[pivot.balance_of(label) for label in sorted(known)], pivot.balance_of("none")).first().asDict()
    assert {k: row[k] for k in known} == {k: plain[k] for k in known} and row["none"] is None
    assert all(isinstance(row[k], Decimal) for k in known) and dict(stored.dtypes)["analytic_data"] == "variant"
    assert stored.select(F.to_json("analytic_data")).first()[0].count(":") == len(known)
