"""Stored pages, journals by month, pivots whose columns are found in the data, and SQL functions."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom import load_books
from ledgerloom.operators import ledger, pivot, reports, statements
from ledgerloom.plans import definitions as d
from ledgerloom.sources import pages, sql_functions
from ledgerloom.sources.books import by_month
from test_published import rows, scanned, whole_plans  # noqa: F401


def listed(df):
    return [tuple(r) for r in df.collect()]


# pages

@pytest.fixture(scope="module")
def stored(spark, tpch, tmp_path_factory):
    """A ledger in some twenty ranges, an eighth of its lines without account."""
    path = str(tmp_path_factory.mktemp("pages"))
    account = F.when(F.col("id") % 8 > 0, F.col("account_id"))
    books = replace(tpch, lines=tpch.lines.withColumn("account_id", account))
    pages.build(books, path, 400)
    return path, listed(ledger.general_ledger(books, ordered=True))


def test_ranges_cover_the_ledger(spark, stored):
    path, whole = stored
    entries = pages.store(spark, path).entries().orderBy("range").collect()
    assert len(entries) > 15 and max(r.lines for r in entries) < 1_200
    assert [r.ahead for r in entries] == [sum(e.lines for e in entries[:i]) for i in range(len(entries))]
    assert pages.lines(spark, path) == len(whole)
    assert [(r.last_account, r.last_date, r.last_id) for r in entries] == [
        (whole[r.ahead + r.lines - 1][4], whole[r.ahead + r.lines - 1][1], whole[r.ahead + r.lines - 1][0]) for r in entries
    ]


@pytest.mark.parametrize("number", [0, 1, 4, 40, 93, 98, 99])
def test_a_page_by_number_reads_its_ranges_only(spark, stored, number):
    path, whole = stored
    found = pages.page(spark, path, number)
    assert listed(found) == whole[80 * number:80 * number + 80]
    assert scanned(found, "balance")[0] <= 2


@pytest.mark.parametrize("at", [0, 399, 2_500, -200, -2, -1])
def test_a_page_after_a_line_reads_its_ranges_only(spark, stored, at):
    path, whole = stored
    at %= len(whole)
    found = pages.page_after(spark, path, whole[at][4], whole[at][1], whole[at][0])
    assert listed(found) == whole[at + 1:at + 81]
    assert scanned(found, "balance")[0] <= 2


def test_a_page_longer_than_a_range(spark, stored):
    path, whole = stored
    assert listed(pages.page(spark, path, 1, size=3_000)) == whole[3_000:6_000]


def test_pages_after_keys_that_no_line_has(spark, make_books, tmp_path):
    lines = [dict(id=n, account_id=None if n % 5 == 0 else n % 3, debit=n, date=None if n % 4 == 0 else date(2020, 1, 1 + n % 6))
             for n in range(1, 60)]
    books = make_books(lines=lines)
    pages.build(books, str(tmp_path), 7)
    for key in [(0, date(2019, 1, 1), 5), (1, date(2020, 1, 3), 0), (1, None, 17), (2, None, 10**9), (None, date(2020, 1, 3), 0), (None, None, 20)]:
        assert listed(pages.page_after(spark, str(tmp_path), *key, size=9)) == listed(ledger.ledger_next_page(books, *key, size=9))


def test_short_ranges_share_files(spark, stored, tmp_path, make_books):
    path, whole = stored
    table = pages.store(spark, path)
    files = len(list(Path(path).glob("data/*/*/*.parquet")))
    assert 0 < files <= int(spark.conf.get("spark.sql.shuffle.partitions")) < len(table.entries().collect())
    # and each is full but for the last of its file
    pages.build(make_books(lines=[dict(id=i, debit=i) for i in range(1, 41)]), str(tmp_path), 3)
    sizes = [r.lines for r in pages.store(spark, str(tmp_path)).entries().orderBy("range").collect()]
    assert sum(sizes) == 40 and max(sizes) == 3 and sum(n < 3 for n in sizes) <= 8


def test_a_stored_ledger_shuffles_full_lines_once(spark, tpch, tmp_path, monkeypatch):
    """The shuffle that the balances need puts the lines in order, too, and no second sort follows."""
    written, write = [], pages.Published.write
    monkeypatch.setattr(pages.Published, "write", lambda self, frame, **how: written.append(frame) or write(self, frame, **how))
    pages.build(tpch, str(tmp_path), 400)
    plan = written[0]._jdf.queryExecution().executedPlan().toString().split("\n")
    above = plan[:next(i for i, line in enumerate(plan) if "Union" in line)]
    assert sum("Exchange " in line for line in above) == sum("Sort " in line for line in above) == 1
    ordering = written[0]._jdf.queryExecution().optimizedPlan().outputOrdering()
    assert ordering.head().child().name() == pages.CHUNK.name  # so that writing does not sort either


def test_the_order_goes_on_through_cut_days_and_nulls(spark, make_books):
    lines = [dict(id=n * 7 % 97, account_id=None if n % 5 == 0 else n % 2, debit=n, date=None if n % 3 == 0 else date(2020, 1, 1 + n % 2))
             for n in range(1, 97)]
    books = make_books(lines=lines)
    assert listed(ledger.arranged_ledger(books, id_span=4).drop("partition")) == listed(ledger.general_ledger(books, ordered=True))


def test_building_again_publishes_at_once(spark, make_books, tmp_path):
    def books(n):
        return make_books(lines=[dict(id=i, debit=i) for i in range(1, n + 1)])

    path = str(tmp_path)
    pages.build(books(50), path, 10)
    old = pages.page(spark, path, 0, 30)
    pages.build(books(5), path, 10)
    assert pages.lines(spark, path) == 5
    assert [r.id for r in pages.page(spark, path, 0, 30).collect()] == [1, 2, 3, 4, 5]
    assert old.count() == 30


def test_pages_of_nothing(spark, make_books, tmp_path):
    path = str(tmp_path)
    pages.build(make_books(), path)
    assert pages.lines(spark, path) == 0
    assert listed(pages.page(spark, path, 0)) == listed(pages.page_after(spark, path, 1, None, 1)) == []
    with pytest.raises(ValueError):
        pages.page(spark, path, -1)


# journals by month

def test_far_apart_reports_leave_the_middle_unread(spark, tpch, tmp_path):
    books = by_month(tpch, str(tmp_path))
    batch = d.definitions(spark, d.SPARSE)
    found = reports.report_lines(books, batch)
    one_month = books.lines.where("month = '1996-06'")
    files, size = scanned(found, "debit")
    whole = scanned(books.lines, "debit")
    # three months of the first report, three of the others; not the fifty between them
    assert files < 0.15 * whole[0] and 0 < size < 12 * scanned(one_month, "debit")[1]
    assert rows(found) == rows(reports.report_lines(tpch, batch))


def test_books_by_month_are_the_same_books(spark, tpch, tmp_path):
    books = by_month(tpch, str(tmp_path))
    for name, df in dict(account_move=tpch.moves, account_account=tpch.accounts, res_company=tpch.companies,
                         account_analytic_account=tpch.analytics).items():
        df.write.parquet(f"{tmp_path}/{name}")
    loaded = load_books(spark, str(tmp_path), month="month")
    assert loaded.month == "month" and rows(loaded.lines) == rows(books.lines)
    for batch in (d.MIXED, d.ZERO, d.ANALYTIC):
        asked = d.definitions(spark, batch)
        assert rows(reports.report_lines(loaded, asked)) == rows(reports.report_lines(tpch, asked))
    assert rows(ledger.general_ledger(loaded)) == rows(ledger.general_ledger(tpch))
    assert rows(statements.balance_sheet(loaded)) == rows(statements.balance_sheet(tpch))


def test_periods_read_their_months(spark, tpch, tmp_path):
    books = by_month(tpch, str(tmp_path))
    start, end = "1996-03-15", "1996-05-20"
    for make, files in [
        (lambda b: statements.income_statement(b, date_start=start, date_end=end), 3),
        (lambda b: pivot.report_pivot_json(b, start, end), 3),
        (lambda b: statements.balance_sheet(b, as_of="1995-03-31", scope="company"), 3),
        (lambda b: statements.cash_flow(b, date_start="1995-02-01", date_end="1995-03-02"), 3),
        (lambda b: ledger.ledger_between(b, start, end).select("id", "date", "debit", "credit", "balance"), None),
    ]:
        assert rows(make(books)) == rows(make(tpch))
        if files is not None:
            assert 0 < scanned(make(books), "debit")[0] <= files
    assert ledger.move_of_line(books, [1]).columns == tpch.lines.columns


def test_no_report_asks_for_no_month(make_books, make_reports, tmp_path):
    books = by_month(make_books(lines=[dict(id=1, debit=1), dict(id=2, debit=1, date=None)]), str(tmp_path))
    assert reports.report_lines(books, make_reports().limit(0)).count() == 0
    backwards = dict(report_id=1, report_type="balance", date_start=date(2020, 5, 1), date_end=date(2020, 1, 1))
    assert reports.report_lines(books, make_reports(backwards)).count() == 0


# pivots whose columns are found in the data

LABELS = [(1, "A"), (2, "a"), (3, "currency_id"), (4, ""), (5, "x.y"), (6, None), (7, "S"), (8, "S"), (9, "unused"), (10, "b`c")]


def labelled(make_books):
    lines = [dict(id=n, account_id=1 + n % 2, analytic_account_id=n if n < 13 else None, debit=10 * n) for n in range(1, 15) if n != 9]
    return make_books(lines=lines, accounts=[dict(id=1, code="1"), dict(id=2, code="2")],
                      analytics=[dict(id=i, code=code) for i, code in LABELS])


@pytest.mark.parametrize("width", [1, 4, 500])
def test_blocks_hold_each_label_in_use_once(make_books, tmp_path, width):
    books = labelled(make_books)
    blocks = pivot.pivot_blocks(books, str(tmp_path), width)
    labels = [label for block in blocks.labels for label in block]
    assert all(len(block) <= width for block in blocks.labels)
    assert set(labels) == {"A", "a#7", "currency_id#9", "##0", "x.y", "#6", "S#7", "S#8", "b`c", "#11", "#12"} and len(labels) == 11
    parts = [block.collect() for block in map(blocks.block, range(len(blocks.labels)))]
    wide = blocks.whole().collect()
    for at, row in enumerate(wide):
        own = {k: v for part in parts for k, v in part[at].asDict().items()}
        assert own == row.asDict()
        known = [row[label] for label in labels if row[label] is not None]
        assert sum(known) + row["balance_without_analytic"] == row["total_balance"]
    assert len(wide) == 2 and {r["a#7"] for r in wide} == {None, 20}


def test_blocks_read_their_own_partition(spark, tpch, tmp_path):
    blocks = pivot.pivot_blocks(tpch, str(tmp_path), 5)
    whole = scanned(spark.read.parquet(f"{tmp_path}/balances"), "balance")
    assert len(blocks.labels) > 3
    assert scanned(blocks._wide(2), "balance")[0] * len(blocks.labels) <= whole[0] * 2
    codes = list(blocks.labels[2])
    assert listed(blocks.block(2)) == listed(pivot.report_pivot(tpch, codes))


def test_blocks_side_by_side_take_no_join_each(tpch, tmp_path):
    plans = []
    for width in (5, 500):
        blocks = pivot.pivot_blocks(tpch, f"{tmp_path}/{width}", width)
        plans.append((len(blocks.labels), blocks.whole()._jdf.queryExecution().optimizedPlan().toString()))
    (many, narrow), (one, wide) = plans
    assert many > 3 and one == 1
    assert narrow.count("Join ") == wide.count("Join ") <= 4


def test_blocks_of_nothing(make_books, tmp_path):
    for name, books in dict(empty=make_books(), plain=make_books(lines=[dict(id=1, debit=5)])).items():
        blocks = pivot.pivot_blocks(books, f"{tmp_path}/{name}")
        assert blocks.labels == ()
        assert [r.total_balance for r in blocks.whole().collect()] == ([] if name == "empty" else [5])


def test_wide_rows_are_made_in_all_tasks_from_arrays(spark, tpch, tmp_path):
    """Narrow rows are few bytes, but not few cells; and a cell is not searched for."""
    blocks = pivot.pivot_blocks(tpch, str(tmp_path), 4)
    found = blocks.whole()
    label = blocks.labels[1][2]
    top = found._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
    assert "[2] AS " + label in top
    lengths = spark.createDataFrame(found.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect())
    assert lengths.count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [(r.account_code, r.company_id, r.account_name) for r in found.select("account_code", "company_id", "account_name").collect()]
    assert keys == sorted(keys, key=lambda k: tuple((x is None, x) for x in k))


# SQL functions

START, END = "1996-03-01", "1997-02-28"
CALLS = [
    ("income_statement()", statements.income_statement, {}),
    (f"income_statement(3, DATE '{START}', DATE '{END}')", statements.income_statement, dict(company_id=3, date_start=START, date_end=END)),
    (f"income_statement(date_end => DATE '{END}')", statements.income_statement, dict(date_end=END)),
    ("balance_sheet()", statements.balance_sheet, {}),
    (f"balance_sheet(2, DATE '{END}')", statements.balance_sheet, dict(company_id=2, as_of=END)),
    ("balance_sheet(scope => 'company')", statements.balance_sheet, dict(scope="company")),
    ("cash_flow()", statements.cash_flow, {}),
    ("cash_flow(company => 4)", statements.cash_flow, dict(company_id=4)),
    (f"cash_flow(2, DATE '{START}')", statements.cash_flow, dict(company_id=2, date_start=START)),
    (f"cash_flow(date_end => DATE '{END}')", statements.cash_flow, dict(date_end=END)),
    (f"cash_flow(NULL, DATE '{START}', DATE '{END}')", statements.cash_flow, dict(date_start=START, date_end=END)),
]


@pytest.mark.parametrize("call, function, arguments", CALLS)
def test_functions_return_the_statements(spark, tpch, call, function, arguments):
    sql_functions.register_functions(tpch, "f_")
    found, expected = spark.sql(f"SELECT * FROM f_{call}"), function(tpch, **arguments)
    assert found.dtypes == expected.dtypes
    assert rows(found) == rows(expected)


def test_the_company_of_the_session(spark, tpch):
    sql_functions.register_functions(tpch, "g_")
    spark.sql("SET VARIABLE g_default_company = 4")
    assert rows(spark.sql("SELECT * FROM g_income_statement()")) == rows(statements.income_statement(tpch, 4))
    assert rows(spark.sql("SELECT * FROM g_income_statement(2)")) == rows(statements.income_statement(tpch, 2))
    spark.sql("SET VARIABLE g_default_company = NULL")
    assert spark.sql("SELECT * FROM g_income_statement()").count() == 5


def test_functions_in_a_query_of_ones_own(spark, tpch):
    sql_functions.register_functions(tpch, "h_")
    found = spark.sql("""SELECT i.company_id, i.net_income, b.total_assets FROM h_income_statement() i
      JOIN h_balance_sheet(scope => 'company') b USING (company_id) WHERE b.total_assets > 0""")
    own = {r.company_id: r for r in statements.income_statement(tpch).collect()}
    assert found.count() > 0 and all(own[r.company_id].net_income == r.net_income for r in found.collect())


def test_functions_push_their_dates_and_company_down(spark, tpch, tmp_path):
    for name, df in dict(account_move_line=tpch.lines, account_move=tpch.moves, account_account=tpch.accounts, res_company=tpch.companies,
                         account_analytic_account=tpch.analytics).items():
        df.write.parquet(f"{tmp_path}/{name}")
    sql_functions.register_functions(load_books(spark, str(tmp_path)), "k_")

    def scans(query):
        text = spark.sql(query)._jdf.queryExecution().executedPlan().toString()
        return [x for x in text.split("\n") if "FileScan" in x and "debit#" in x], text

    lines, text = scans(f"SELECT net_income FROM k_income_statement(3, DATE '{START}', DATE '{END}')")
    assert len(lines) == 1 and f"GreaterThanOrEqual(date,{START})" in lines[0] and f"LessThanOrEqual(date,{END})" in lines[0]
    assert "EqualTo(company_id,3)" in lines[0] and "NestedLoop" not in text and "Cartesian" not in text
    # of the two forms of the cash flow only the one that is asked for is planned
    assert len(scans(f"SELECT * FROM k_cash_flow(3, DATE '{START}')")[0]) == len(scans("SELECT * FROM k_cash_flow()")[0]) == 1


def test_functions_on_books_with_gaps(spark, make_books):
    day = date(2020, 1, 1)
    books = make_books(
        lines=[dict(id=1, account_id=1, credit=7), dict(id=2, account_id=2, debit=3), dict(id=3, account_id=1, credit=5, company_id=None),
               dict(id=4, account_id=3, debit=2, date=None), dict(id=5, account_id=3, debit=9, date=day + timedelta(9)),
               dict(id=6, account_id=9, debit=1), dict(id=7, account_id=2, debit=None, credit=1), dict(id=8, account_id=1, credit=4, move_id=2)],
        moves=[dict(id=1), dict(id=2, state="draft")],
        accounts=[dict(id=1, code="7", internal_type="income"), dict(id=2, internal_type="expense"), dict(id=3, code="1011")],
        companies=[dict(id=1, name=None), dict(id=2, name="O'Neil")],
    )
    sql_functions.register_functions(books, "m_")
    for call, function, arguments in [
        ("income_statement()", statements.income_statement, {}), ("balance_sheet()", statements.balance_sheet, {}),
        ("balance_sheet(scope => 'company')", statements.balance_sheet, dict(scope="company")), ("cash_flow()", statements.cash_flow, {}),
        ("cash_flow(date_start => DATE '2020-01-05')", statements.cash_flow, dict(date_start="2020-01-05")),
        ("cash_flow(date_end => DATE '2020-01-05')", statements.cash_flow, dict(date_end="2020-01-05")),
    ]:
        assert rows(spark.sql(f"SELECT * FROM m_{call}")) == rows(function(books, **arguments)), call
