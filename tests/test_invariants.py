"""Identities that hold on any books, checked on the derived ones."""

from __future__ import annotations

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import Window, functions as F

from ledgerloom.operators import ledger, pivot, reports, statements
from ledgerloom.plans import definitions as d
from ledgerloom.sources import views


def by_company(df, *columns):
    return {r.company_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_derived_books(tpch):
    lines = tpch.lines
    assert (lines.count(), lines.select("id").distinct().count()) == (12_000, 12_000)
    facts = lines.select(
        F.count_if(F.col("date").isNull()), F.count_if(F.col("analytic_account_id").isNull()),
        F.count_if(F.col("parent_state") == "posted"),
    ).first()
    assert tuple(facts) == (228, 3316, 7856)
    accounts = tpch.accounts.select(
        F.count("*"), F.count_if("deprecated"), F.count_if(F.col("code").isNull()),
        F.count_if(F.col("code").startswith("101")),
    ).first()
    assert tuple(accounts) == (200, 19, 12, 26)
    own = lines.join(tpch.accounts.withColumnRenamed("id", "account_id"), ["account_id", "company_id"])
    assert own.count() == 2388


def test_split_ledger_equals_a_plain_window(tpch):
    window = Window.partitionBy("account_id").orderBy(F.col("date").asc_nulls_last(), "id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    plain = ledger.ledger_base(tpch).withColumn(
        "balance", F.sum(F.col("debit") - F.col("credit")).over(window).cast("decimal(28,2)")
    ).select(*ledger.LEDGER_COLUMNS)
    for span in (1_000, 100_000, ledger.ID_SPAN):
        split = ledger.general_ledger(tpch, id_span=span)
        assert split.exceptAll(plain).count() == 0
        assert plain.exceptAll(split).count() == 0


def test_ordered_ledger(tpch):
    rows = ledger.general_ledger(tpch, ordered=True).select("account_id", "date", "id").collect()
    key = [(r.account_id, r.date is None, r.date or date.min, r.id) for r in rows]
    assert key == sorted(key)


def test_last_balance_is_the_account_total(tpch):
    full = ledger.general_ledger(tpch)
    last = full.groupBy("account_id").agg(
        F.max_by("balance", F.struct(F.col("date").isNull(), "date", "id")).alias("balance")
    )
    sums = full.groupBy("account_id").agg(F.sum(F.col("debit") - F.col("credit")).cast("decimal(28,2)").alias("balance"))
    assert last.exceptAll(sums).count() == 0


def test_groups_add_up_to_the_footer(tpch):
    rows = ledger.ledger_groups(tpch, "journal_id", totals=True).collect()
    footer = [r for r in rows if r.level == 0]
    assert len(footer) == 1
    for column in ("debit", "credit", "line_count"):
        assert footer[0][column] == sum(r[column] for r in rows if r.level == 1)


def test_income_arithmetic(tpch):
    for r in statements.income_statement(tpch).collect():
        assert r.gross_profit == r.revenue - r.cost_of_sales
        assert r.net_income == r.operating_income


@pytest.mark.parametrize("scope", ["global", "company"])
def test_sides_differ_by_the_result(tpch, scope):
    rows = statements.balance_check(tpch, scope=scope).collect()
    assert len(rows) == 5
    assert all(r.unexplained == 0 and r.difference == r.period_result != 0 for r in rows)


def test_balance_sheets_add_up_to_the_global_one(tpch):
    own = by_company(statements.balance_sheet(tpch, scope="company"), "total_assets", "total_equity")
    everything = by_company(statements.balance_sheet(tpch), "total_assets", "total_equity")
    total = tuple(sum(column) for column in zip(*own.values()))
    assert set(everything.values()) == {total}


def test_dated_and_undated_income_make_all_time(tpch):
    undated = type(tpch)(
        tpch.lines.where("date is null"), tpch.moves, tpch.accounts, tpch.companies, tpch.analytics
    )
    parts = [
        by_company(statements.income_statement(tpch, date_start="1900-01-01", date_end="2100-01-01"), "net_income"),
        by_company(statements.income_statement(undated), "net_income"),
    ]
    whole = by_company(statements.income_statement(tpch), "net_income")
    assert whole == {c: (parts[0][c][0] + parts[1][c][0],) for c in whole}


def test_adjacent_cash_periods_meet(tpch):
    first = by_company(statements.cash_flow(tpch, date_start="1996-01-01", date_end="1996-12-31"), "ending_cash")
    second = by_company(statements.cash_flow(tpch, date_start="1997-01-01", date_end="1997-12-31"), "beginning_cash")
    assert first == second
    assert any(v != (D(0),) for v in first.values())


def test_statement_of_one_company_is_its_row(tpch):
    for make in (statements.income_statement, statements.balance_sheet, statements.cash_flow):
        rows = {r.company_id: r for r in make(tpch).collect()}
        assert make(tpch, company_id=3).collect() == [rows[3]]


def test_totals_are_the_sum_of_lines(spark, tpch):
    batch = d.definitions(spark, d.MIXED)
    lines = reports.report_lines(tpch, batch)
    sums = {}
    for r in lines.collect():
        sums[r.report_id] = sums.get(r.report_id, D(0)) + r.balance
    totals = {r.report_id: r.total_balance for r in reports.report_totals(lines, batch).collect()}
    assert totals == {one[0]: sums.get(one[0], D(0)) for one in d.MIXED}


def test_flat_report_is_the_grouped_one_summed(spark, tpch):
    batch = [(1, "grouped", *d.ZERO[0][2:7], True, True), (2, "flat", *d.ZERO[0][2:7], True, False)]
    rows = reports.report_lines(tpch, d.definitions(spark, batch))
    summed = {
        r.account_id: r.b for r in rows.where("report_id = 1").groupBy("account_id").agg(F.sum("balance").alias("b")).collect()
    }
    flat = {r.account_id: r.balance for r in rows.where("report_id = 2").collect()}
    assert summed == {a: b for a, b in flat.items() if a in summed}
    assert len(flat) > len(summed) > 0
    assert all(b == 0 for a, b in flat.items() if a not in summed)


def test_pivot_rows_are_the_ledger_per_company_and_account(tpch):
    posted = tpch.lines.where("parent_state = 'posted'")
    sums = posted.groupBy("company_id", "account_id").agg(
        F.sum(F.col("debit") - F.col("credit")).cast("decimal(28,2)").alias("total_balance")
    )
    used = posted.where("analytic_account_id IS NOT NULL").select("analytic_account_id").distinct().collect()
    labels = [f"AN{n:09d}" if n < 1_000_000_000 else f"#{n}" for (n,) in sorted(used)]
    assert any(label.startswith("#") for label in labels)
    wide = pivot.report_pivot(tpch, labels)
    assert wide.select(*sums.columns).exceptAll(sums).count() == 0
    parts = [*labels, "balance_without_analytic"]
    total = sum((F.coalesce(c, F.lit(0)) for c in parts[1:]), F.coalesce(parts[0], F.lit(0)))
    assert wide.where(total != F.col("total_balance")).count() == 0


def test_views_answer_sql(spark, tpch):
    views.register_views(tpch, prefix="t_", today="2001-01-01")
    views.register_views(tpch, prefix="t_", today="2001-01-02")
    assert spark.sql("SELECT count(*) FROM t_general_ledger WHERE account_id = 7").first()[0] > 0
    for name in ("income_statement", "balance_sheet", "cash_flow"):
        assert spark.sql(f"SELECT * FROM t_{name} WHERE company_id = 2").count() == 1
    assert str(spark.sql("SELECT date FROM t_balance_sheet").first()[0]) == "2001-01-02"
