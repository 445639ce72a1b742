"""Skewed books, and the plans that keep them apart.

A third of all lines sits on one account, one day, one entry and one company. The ledger
must still be right, and no group that a task has to sort whole may hold that third.
"""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom import load_books
from ledgerloom.operators import ledger, pivot, reports, statements
from ledgerloom.plans import definitions as d
from ledgerloom.sources.books import Books


HOT = 2  # an asset account of company 1


@pytest.fixture(scope="module")
def skewed(tpch) -> Books:
    hot = F.col("id") % 3 == 0
    to = {"account_id": F.lit(HOT), "move_id": F.lit(1), "company_id": F.lit(1), "date": F.lit("1996-06-30").cast("date")}
    lines = tpch.lines.withColumns({
        c: F.when(hot, value.cast(tpch.lines.schema[c].dataType)).otherwise(F.col(c)) for c, value in to.items()
    })
    return Books(lines, tpch.moves, tpch.accounts, tpch.companies, tpch.analytics)


@pytest.fixture(scope="module")
def stored_books(spark, tpch, tmp_path_factory) -> Books:
    path = str(tmp_path_factory.mktemp("books"))
    names = dict(account_move_line=tpch.lines, account_move=tpch.moves, account_account=tpch.accounts,
                 res_company=tpch.companies, account_analytic_account=tpch.analytics)
    for name, df in names.items():
        df.write.parquet(f"{path}/{name}")
    return load_books(spark, path)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def scans(df: DataFrame, column: str) -> list[str]:
    return [line for line in plan(df).split("\n") if "FileScan" in line and f"{column}#" in line]


def plain_balance(books: Books) -> dict:
    window = Window.partitionBy("account_id").orderBy(F.col("date").asc_nulls_last(), "id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rows = ledger.ledger_base(books).select("id", F.sum(F.col("debit") - F.col("credit")).over(window).alias("b"))
    return {r.id: r.b for r in rows.collect()}


@pytest.mark.parametrize("span", [50, 1_000, ledger.ID_SPAN])
def test_hot_account_and_day(skewed, span):
    rows = ledger.general_ledger(skewed, id_span=span).collect()
    assert {r.id: r.balance for r in rows} == plain_balance(skewed)
    assert sum(r.account_id == HOT for r in rows) > len(rows) / 4


def test_hot_groups_without_broadcast(skewed, no_broadcast):
    rows = ledger.general_ledger(skewed).collect()
    assert {r.id: r.balance for r in rows} == plain_balance(skewed)


def test_slot_holds_at_most_its_span(skewed):
    span = 1_000
    base = ledger.ledger_base(skewed)
    sizes = ledger._with_slot(skewed, base, span).groupBy("account_id", "date", "slot").count()
    hot_day = base.groupBy("account_id", "date").count().agg(F.max("count")).first()[0]
    assert sizes.agg(F.max("count")).first()[0] <= span < hot_day / 2
    # only the hot day is cut
    assert sizes.where("slot is not null").select("account_id", "date").distinct().count() == 1


def test_busy_days_are_few(skewed):
    span = 100
    lines = skewed.lines.where("parent_state = 'posted'").count()
    assert 0 < ledger._busy_days(skewed, span).count() <= lines / span


def test_ledger_never_windows_a_whole_account_of_lines(stored_books):
    text = plan(ledger.general_ledger(stored_books))
    windows = re.findall(r"\bWindow \[sum\([^()]*\) windowspecdefinition\((.*?), specifiedwindowframe", text)
    keys = {tuple(re.findall(r"\b(account_id|date|slot|id)#", w)) for w in windows}
    # lines inside a slot, then sums per slot inside a day, and per day inside an account
    assert keys == {("account_id", "date", "slot", "id"), ("account_id", "date", "slot"), ("account_id", "date")}
    over_lines = [w for w in text.split("\n") if "Window [" in w and re.search(r"\bid#", w)]
    assert len(over_lines) == 1


@pytest.mark.parametrize("complete", [False, True])
def test_history_without_busy_days_is_read_in_two_narrow_passes(stored_books, complete):
    execution = ledger.general_ledger(replace(stored_books, complete=complete))._jdf.queryExecution()
    execution.toRdd().count()
    final = execution.executedPlan().toString().split("== Initial Plan ==")[0]
    scanned = [line for line in final.split("\n") if "FileScan" in line and "account_id#" in line]
    narrow = [line for line in scanned if "partner_id#" not in line]
    # no slot was found to fill: only the days are summed (and the busy ones, which are
    # none, are gone from the final plan)
    assert len(scanned) - len(narrow) == 1 and 1 <= len(narrow) <= 2
    assert "slot#" not in "".join(line for line in final.split("\n") if "HashAggregate" in line)


def test_filters_reach_the_scan_of_lines(stored_books):
    by_account = scans(ledger.ledger_search(stored_books, account_id=7), "account_id")
    assert by_account and all("EqualTo(account_id,7)" in line for line in by_account)
    between = plan(ledger.general_ledger(stored_books).where("date between '1996-03-01' and '1997-02-28'"))
    lines = [x for x in between.split("\n") if "FileScan" in x and "account_id#" in x]
    full = [x for x in lines if "partner_id#" in x]
    assert len(full) == 1 and "1996" in full[0].split("DataFilters")[1]
    # the movements behind the opening balances are not cut off by the period
    assert any("1996" not in x and "debit#" in x for x in lines)


def test_period_reads_full_lines_of_the_period_only(stored_books):
    text = plan(ledger.ledger_between(stored_books, "1996-03-01", "1997-02-28"))
    lines = [x for x in text.split("\n") if "FileScan" in x and "account_id#" in x]
    full = [x for x in lines if "partner_id#" in x]
    assert len(full) == 1 and "GreaterThanOrEqual(date,1996-03-01)" in full[0]
    # nothing behind the period is read; what is ahead of it only by the sums per account
    assert all("LessThanOrEqual(date,1997-02-28)" in x for x in lines)
    history = [x for x in lines if "GreaterThanOrEqual(date" not in x]
    assert history and all("debit#" in x and "partner_id#" not in x for x in history)


def test_search_shuffles_amounts_and_matches_only(stored_books, skewed):
    found = ledger.ledger_search(stored_books, partner_id=7)
    # once for the matches with all their columns, once for their days; both by the term
    full = [x for x in scans(found, "account_id") if "partner_id#" in x]
    assert len(full) >= 2 and all("partner_id#" in x.split("DataFilters")[1] for x in full)
    assert sum("ref#" in x for x in full) == 1
    for terms in (dict(partner_id=7), dict(journal_id=2, ref="f"), dict(account_id=HOT, ref="r")):
        rows = ledger.ledger_search(skewed, **terms)
        conditions = [f"{k} = {v}" if isinstance(v, int) else f"{k} ilike '%{v}%'" for k, v in terms.items()]
        filtered = ledger.general_ledger(skewed).where(" and ".join(conditions))
        assert sorted(map(str, rows.collect())) == sorted(map(str, filtered.collect()))
        assert rows.count() > 0


def test_period_of_skewed_books(skewed):
    for start, end in [("1996-06-30", "1996-06-30"), ("1996-07-01", "1997-01-01"), (None, "1996-06-30"), ("1996-06-01", None)]:
        rows = ledger.ledger_between(skewed, start, end)
        whole = ledger.general_ledger(skewed).where(
            f"date >= '{start or '1900-01-01'}' and date <= '{end or '2100-01-01'}'"
        )
        assert sorted(map(str, rows.collect())) == sorted(map(str, whole.collect()))


@pytest.mark.parametrize("make, expected", [
    (statements.income_statement, 1), (statements.balance_sheet, 1), (statements.cash_flow, 1),
    (lambda b: statements.cash_flow(b, date_start="1996-01-01"), 1),
    (lambda b: statements.balance_check(b, scope="company"), 1),
    (lambda b: ledger.ledger_groups(b, "partner_id", totals=True), 1),
    (lambda b: pivot.report_pivot(b, ["AN000000001"]), 1),
    (lambda b: pivot.report_pivot_json(b), 1),
])
def test_one_scan_of_lines(stored_books, make, expected):
    assert len(scans(make(stored_books), "debit")) == expected


def test_statements_prune_columns(stored_books):
    for line in scans(statements.balance_sheet(stored_books), "debit"):
        schema = line.split("ReadSchema: ")[1]
        assert "partner_id" not in schema and "date" not in schema and "EqualTo(parent_state,posted)" in line


def everything(spark, books) -> list[DataFrame]:
    return [
        ledger.general_ledger(books), ledger.ledger_first_page(books), ledger.ledger_groups(books),
        ledger.move_of_line(books, ledger.ledger_base(books)),
        statements.income_statement(books), statements.balance_sheet(books), statements.cash_flow(books),
        statements.balance_check(books), reports.report_lines(books, d.definitions(spark, d.MIXED)),
        pivot.report_pivot_json(books),
    ]


def test_no_udf_and_no_cross_join(spark, stored_books):
    for df in everything(spark, stored_books):
        text = plan(df)
        assert not re.search(r"Python|CartesianProduct|BroadcastNestedLoopJoin", text), text


def test_no_cross_join_without_broadcast(spark, stored_books, no_broadcast):
    for df in everything(spark, stored_books):
        text = plan(df)
        assert not re.search(r"Python|CartesianProduct|NestedLoop", text), text


def test_reports_meet_lines_of_the_asked_accounts_only(spark, stored_books):
    text = plan(reports.report_lines(stored_books, d.definitions(spark, d.MIXED)))
    above = text[: text.index("parent_state#")].split("\n")
    order = [re.search(r"(HashAggregate|Exchange hashpartitioning|Join)", line) for line in above]
    # a semi-join by account, then the sums ahead of the shuffle
    assert [m.group(1) for m in order if m][-3:] == ["Exchange hashpartitioning", "HashAggregate", "Join"]


def overlapping(n: int) -> list[tuple]:
    return [(i, f"r{i}", "income", date(1994, 1, 1) + timedelta(days=600 * i // n), date(1998, 1, 1) + timedelta(days=400 * i // n), [1], [], False, True)
            for i in range(1, n + 1)]


def test_overlapping_reports_grow_in_proportion(spark, stored_books):
    """Rows that enter the window: movements once, and two per report and series."""
    sizes = []
    for n in (50, 100, 200, 400):
        batch = d.definitions(spark, overlapping(n))
        asked = reports._report_accounts(stored_books, batch)
        moved = reports._movements(stored_books, asked, batch)
        series = moved.select(*reports.SERIES).distinct()
        sizes.append(2 * asked.join(series, ["company_id", "account_id"]).count() / n)
        execution = reports._in_periods(asked, moved)._jdf.queryExecution()
        assert "NestedLoop" not in execution.executedPlan().toString()
    assert max(sizes) <= 1.2 * min(sizes)


def test_no_task_holds_an_account_with_many_analytics(spark, make_books, make_reports):
    """The hot account's series are dealt out by analytic account too."""
    lines = [dict(id=i, account_id=1, debit=i % 7, analytic_account_id=i % 900) for i in range(1800)]
    lines += [dict(id=5000 + i, account_id=2, debit=1, analytic_account_id=i % 3) for i in range(900)]
    books = make_books(lines=lines, accounts=[dict(id=1), dict(id=2)])
    batch = make_reports(dict(report_id=1, report_type="balance"))
    asked = reports._report_accounts(books, batch)
    moved = reports._movements(books, asked, batch)
    per_task = moved.repartition(16, *reports.SERIES).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in per_task) < 0.15 * moved.count()
    text = plan(reports._in_periods(asked, moved))
    windows = re.findall(r"Window \[.*?windowspecdefinition\((.*?), specifiedwindowframe", text)
    assert windows and all("analytic_account_id" in w for w in windows)


def test_search_windows_only_days_with_a_hit(spark, stored_books):
    found = ledger.ledger_base(stored_books).where("partner_id = 7")
    days = {(r.account_id, r.date) for r in found.select("account_id", "date").collect()}
    execution = ledger.ledger_search(stored_books, partner_id=7)._jdf.queryExecution()
    execution.toRdd().count()
    final = execution.executedPlan().toString().split("== Initial Plan ==")[0]
    assert "LeftSemi" in final
    base = ledger.ledger_base(stored_books)
    near = sum((r.account_id, r.date) in days for r in base.select("account_id", "date").collect())
    assert near < base.count() / 10


@pytest.mark.parametrize("date_, size", [("1996-05-05", 30), (None, 30), ("1992-01-01", 400)])
def test_next_page_follows_the_ledger(stored_books, date_, size):
    rows = [tuple(r) for r in ledger.general_ledger(stored_books, ordered=True).collect()]
    key = lambda r: (r[4] is None, r[4] or 0, r[1] is None, r[1] or date(1, 1, 1), r[0])
    after = (False, 7, date_ is None, date.fromisoformat(date_) if date_ else date(1, 1, 1), 0)
    expected = [r for r in rows if key(r) > after][:size]
    assert [tuple(r) for r in ledger.ledger_next_page(stored_books, 7, date_, 0, size).collect()] == expected


def test_ordered_ledger(stored_books):
    rows = [(r.account_id is None, r.account_id, r.date is None, r.date or date(1, 1, 1), r.id) for r in ledger.general_ledger(stored_books, ordered=True).collect()]
    assert rows == sorted(rows)


def test_skewed_statements_and_reports(spark, skewed, no_broadcast):
    """Same answers with joins that shuffle as a direct sum over joined lines gives."""
    joined = skewed.lines.alias("l").join(
        skewed.accounts.alias("a"), F.col("l.account_id") == F.col("a.id")
    ).where("l.parent_state = 'posted' and a.internal_type = 'asset'")
    expected = joined.agg(F.sum(F.col("debit") - F.col("credit"))).first()[0]
    assert {r.total_assets for r in statements.balance_sheet(skewed).collect()} == {expected}

    batch = d.definitions(spark, [(1, "all", "balance", *d._year(1990, 2005), [1, 2, 3, 4, 5], [], True, False)])
    lines = reports.report_lines(skewed, batch)
    hot = lines.where(F.col("account_id") == HOT).first()
    direct = skewed.lines.where(
        "parent_state = 'posted' and company_id = 1 and date between '1990-01-01' and '2005-12-31'"
    ).where(F.col("account_id") == HOT).agg(F.sum("debit"), F.sum("credit")).first()
    assert (hot.debit, hot.credit) == tuple(direct)
    assert hot.debit + hot.credit > 0


@pytest.fixture
def small_skew_limits(spark):
    """Limits of the adaptive skew join, scaled down to the test data."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "4000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


@pytest.mark.parametrize("make", [ledger.ledger_base, ledger.general_ledger, statements.income_statement])
def test_hot_entry_is_split_by_the_adaptive_join(spark, tpch, small_skew_limits, make):
    # Several map tasks, as on a cluster: a hot partition is split along them.
    lines = tpch.lines.withColumn("move_id", F.expr("if(id % 5 < 2, 1L, move_id)")).repartition(8)
    df = make(Books(lines, tpch.moves, tpch.accounts, tpch.companies, tpch.analytics))
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    final = execution.executedPlan().toString().split("== Initial Plan ==")[0]
    assert re.search(r"SortMergeJoin\(skew=true\) \[move_id#", final), final


@pytest.mark.parametrize("make", [
    ledger.general_ledger, ledger.ledger_base, ledger.ledger_first_page, ledger.ledger_groups,
    lambda b: ledger.ledger_between(b, "1996-01-01", "1996-12-31"),
    lambda b: ledger.move_of_line(b, b.lines.where("ref = 'RF'")),
])
def test_complete_books_give_the_same_without_the_checks(tpch, make):
    unchecked = Books(tpch.lines, tpch.moves, tpch.accounts, tpch.companies, tpch.analytics)
    assert tpch.complete and not unchecked.complete
    fast, checked = make(tpch), make(unchecked)
    assert sorted(map(str, fast.collect())) == sorted(map(str, checked.collect()))


def test_complete_books_sum_history_without_a_join(tpch, no_broadcast):
    text = plan(ledger.ledger_groups(tpch))
    assert "move_id#" not in text and text.count("SortMergeJoin") == 1  # the line items with their orders


@pytest.mark.parametrize("make", [
    lambda b: statements.income_statement(b, company_id=3),
    lambda b: statements.balance_sheet(b, company_id=3, scope="company"),
    lambda b: statements.cash_flow(b, company_id=3, date_start="1996-01-01"),
])
def test_statement_of_one_company_reads_its_lines(stored_books, make):
    scanned = scans(make(stored_books), "debit")
    assert len(scanned) == 1 and "EqualTo(company_id,3)" in scanned[0]


def test_reports_read_the_days_of_the_batch(spark, stored_books):
    text = plan(reports.report_lines(stored_books, d.definitions(spark, d.FLAT)))
    lines = [x for x in text.split("\n") if "FileScan" in x and "debit#" in x]
    assert len(lines) == 1 and "date#" in lines[0].split("DataFilters")[1].split("Format")[0]
    assert "ReadSchema: struct<account_id:bigint,company_id:bigint,date:date,debit:decimal(15,2)," in lines[0]


def test_derived_lines_are_shuffled_once_each(tpch, no_broadcast):
    # of the tables, only the companies are small
    df = ledger.general_ledger(replace(tpch, companies=tpch.companies.hint("broadcast")))
    text = plan(df)
    # the lines lie by entry when they meet their entries, and meet the busy days where they are
    assert "SortMergeJoin [move_id#" in text
    assert text.count("Exchange hashpartitioning(move_id#") == 1  # the entries
    assert not re.search(r"Exchange hashpartitioning\(coalesce\(account_id#", text)
    # opening balances and busy days start from the same sums
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    final = execution.executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("partial_sum(amount") == 1


@pytest.mark.parametrize("make", [
    ledger.general_ledger,
    lambda b: ledger.general_ledger(b).select(*ledger.LIST_COLUMNS),
    lambda b: ledger.ledger_search(b, move_name="move/7"),
])
def test_sums_and_lines_share_the_shuffle_of_the_items(tpch, no_broadcast, make):
    execution = make(replace(tpch, companies=tpch.companies.hint("broadcast")))._jdf.queryExecution()
    execution.toRdd().count()
    final = execution.executedPlan().toString().split("== Initial Plan ==")[0]
    items = [x for x in final.split("\n") if "FileScan" in x and "l_extendedprice#" in x]
    # the days' sums read what numbers the lines, so they take the lines' own shuffle, and none of fewer columns
    assert items and all("l_discount#" in x for x in items)


@pytest.mark.parametrize("complete", [False, True])
def test_a_day_of_lines_without_id_counts(make_books, complete):
    books = make_books([{"id": None, "date": date(2020, 1, 1), "debit": 5}, {"id": 2, "date": date(2020, 1, 2), "debit": 3}])
    rows = ledger.general_ledger(replace(books, complete=complete)).collect()
    assert [(r.id, r.balance) for r in rows] == [(2, 8)]
