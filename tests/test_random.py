"""Random small books against plain Python loops."""

from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal as D

import pytest

from ledgerloom.operators import ledger, reports, statements

START = date(2020, 1, 1)
FAR = date(9999, 12, 31)


def random_lines(seed: int, size: int) -> list[dict]:
    pick = random.Random(seed)

    def amount():
        return pick.choice([None, D(0), D(pick.randrange(1, 10_000)) / 100])

    ids = pick.sample(range(-200, 2_000), size)
    return [
        dict(
            id=i, move_id=pick.choice([None, 1, 2, 3, 99]), account_id=pick.choice([None, 1, 1, 1, 2, 3]),
            partner_id=pick.choice([None, 1, 2]), company_id=pick.choice([None, 1, 1, 2, 98]),
            date=pick.choice([None, *(START + timedelta(days=n) for n in (0, 0, 0, 1, 2, 30))]),
            debit=amount(), credit=amount(), parent_state=pick.choice(["posted", "posted", "draft", None]),
            analytic_account_id=pick.choice([None, 1, 2]),
        )
        for i in ids
    ]


def difference(line):
    return None if line["debit"] is None or line["credit"] is None else line["debit"] - line["credit"]


def balances(lines: list[dict]) -> dict[int, D | None]:
    seen, result = {}, {}
    kept = [x for x in lines if x["parent_state"] == "posted" and x["move_id"] in (1, 2, 3) and x["company_id"] in (1, 2)]
    for x in sorted(kept, key=lambda x: (x["date"] or FAR, x["id"])):
        term, before = difference(x), seen.get(x["account_id"])
        seen[x["account_id"]] = before if term is None else (before or D(0)) + term
        result[x["id"]] = seen[x["account_id"]]
    return result


@pytest.fixture(params=[1, 2, 3])
def drawn(request, make_books):
    lines = random_lines(request.param, 400)
    books = make_books(
        lines=lines, moves=[dict(id=n, name=f"M/{n}") for n in (1, 2, 3)],
        accounts=[dict(id=1, internal_type="income", code="70"), dict(id=2, internal_type="expense", code="5"),
                  dict(id=3, internal_type="expense", company_id=2)],
        companies=[dict(id=1), dict(id=2)], analytics=[dict(id=1, code="A1")],
    )
    return lines, books


def test_running_balance(drawn):
    lines, books = drawn
    expected = balances(lines)
    assert len(expected) > 50
    for span in (7, 150, ledger.ID_SPAN):
        assert {r.id: r.balance for r in ledger.general_ledger(books, id_span=span).collect()} == expected


def test_period_search_and_page(drawn):
    lines, books = drawn
    expected = balances(lines)
    line = {x["id"]: x for x in lines}
    inside = {i: b for i, b in expected.items() if line[i]["date"] and date(2020, 1, 2) <= line[i]["date"] <= date(2020, 1, 30)}
    assert {r.id: r.balance for r in ledger.ledger_between(books, "2020-01-02", "2020-01-30").collect()} == inside
    mine = {i: b for i, b in expected.items() if line[i]["partner_id"] == 2 and line[i]["move_id"] == 3}
    assert {r.id: r.balance for r in ledger.ledger_search(books, partner_id=2, move_name="m/3").collect()} == mine
    order = sorted(expected, key=lambda i: (
        line[i]["account_id"] is None, line[i]["account_id"] or 0, line[i]["date"] or FAR, i
    ))
    page = [(r.id, r.balance) for r in ledger.ledger_first_page(books, 25).collect()]
    assert page == [(i, expected[i]) for i in order[:25]]


def test_income_statement(drawn):
    lines, books = drawn
    for company in (1, 2):
        income = cost = other = D(0)
        for x in lines:
            term = difference(x)
            if x["company_id"] != company or x["move_id"] not in (1, 2, 3) or term is None:
                continue
            income -= term if x["account_id"] == 1 else 0
            cost += term if x["account_id"] == 2 else 0
            other += term if x["account_id"] == 3 else 0
        row = statements.income_statement(books, company_id=company).first()
        assert (row.revenue, row.cost_of_sales, row.operating_expenses) == (income, cost, D(0))
        assert row.net_income == income - cost - other


def test_overlapping_reports(drawn, make_reports):
    lines, books = drawn
    periods = {1: (0, 0), 2: (0, 2), 3: (1, 1), 4: (2, 40), 5: (31, 40), 6: (0, 40)}
    definitions = make_reports(*[
        dict(report_id=n, date_start=START + timedelta(days=a), date_end=START + timedelta(days=b),
             company_ids=[1, 2], include_zero_lines=True)
        for n, (a, b) in periods.items()
    ])
    expected = {}
    owner = {1: 1, 2: 1, 3: 2}
    for n, (a, b) in periods.items():
        for x in lines:
            if x["parent_state"] != "posted" or x["date"] is None or x["company_id"] != owner.get(x["account_id"]):
                continue
            if x["company_id"] is not None and START + timedelta(days=a) <= x["date"] <= START + timedelta(days=b):
                key = (n, x["account_id"], x["analytic_account_id"])
                debit, credit = expected.get(key, (D(0), D(0)))
                expected[key] = (debit + (x["debit"] or 0), credit + (x["credit"] or 0))
    rows = {
        (r.report_id, r.account_id, r.analytic_account_id): (r.debit, r.credit)
        for r in reports.report_lines(books, definitions).collect()
    }
    assert rows == expected


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_cash_flow(make_books, seed):
    lines = random_lines(seed, 300)
    codes = {1: "10110", 2: "10120", 3: "6820"}
    books = make_books(
        lines=lines, moves=[dict(id=1)],
        accounts=[dict(id=n, code=c, internal_type="expense" if n == 3 else "asset") for n, c in codes.items()],
        companies=[dict(id=1), dict(id=2)],
    )

    def total(kept):
        return sum((difference(x) or D(0) for x in lines if kept(x)), D(0))

    def posted(x):
        return x["parent_state"] == "posted"

    change = total(lambda x: x["account_id"] == 1 or (x["account_id"] == 2 and posted(x)))
    result = total(lambda x: x["account_id"] == 3 and posted(x))
    cash = [x for x in lines if x["account_id"] in (1, 2) and posted(x)]
    first = difference(min(cash, key=lambda x: (x["date"] or FAR, x["id"])))
    rows = statements.cash_flow(books).collect()
    assert len(rows) == 2
    for row in rows:
        assert (row.net_change_cash, row.net_income, row.adjustments) == (change, -result, result)
        assert row.beginning_cash == (first or D(0))

    since, until = START + timedelta(days=1), START + timedelta(days=2)
    for row in statements.cash_flow(books, date_start=since, date_end=until).collect():
        def own(x):
            return x["account_id"] in (1, 2) and posted(x) and x["company_id"] == row.company_id and x["date"]
        opening = total(lambda x: own(x) and x["date"] < since)
        inside = total(lambda x: own(x) and since <= x["date"] <= until)
        assert (row.beginning_cash, row.net_change_cash, row.ending_cash) == (opening, inside, opening + inside)
