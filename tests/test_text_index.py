"""Substring search by the index of three letters, against the scan."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_published import rows, scanned

from ledgerloom.operators import ledger
from ledgerloom.sources import text_index


@pytest.fixture
def mixed(make_books):
    names = ["INV/2020/001", "inv/2020/002", "Ñandú 7", "ab", "", "aaaa", "MOVE%_1", None]
    refs = ["RF", "Payment of INV/2020/001", "a%b", "rf rf", None, "ÑANDÚ", "x", "İstanbul"]
    lines = [dict(id=10 * i + k, move_id=i, ref=refs[(i + k) % 8], debit=i + k) for i in range(8) for k in range(3)]
    return make_books(lines=lines, moves=[dict(id=i, name=n) for i, n in enumerate(names)])


NEEDLES = {"move_name": ["2020/00", "ñandú", "a", "aaa", "%_1", "nothing"], "ref": ["inv/2020/001", "rf", "rf rf", "istan"]}


@pytest.mark.parametrize("literals", [text_index.LITERALS, 0])
def test_index_finds_what_the_scan_finds(spark, mixed, tmp_path, literals):
    path = str(tmp_path / "index")
    text_index.build(mixed, path)
    for field, needles in NEEDLES.items():
        for needle in needles:
            found = text_index.ledger_search(mixed, path, **{field: needle}, literals=literals)
            assert rows(found) == rows(ledger.ledger_search(mixed, **{field: needle})), (field, needle)
    both = dict(move_name="20", ref="a", partner_id=1)
    assert rows(text_index.ledger_search(mixed, path, **both, literals=literals)) == rows(ledger.ledger_search(mixed, **both))


def test_added_lines_are_found_before_and_after_a_merge(spark, mixed, tmp_path):
    path = str(tmp_path / "index")
    old = replace(mixed, lines=mixed.lines.where("move_id < 3"), moves=mixed.moves.where("id < 3"))
    text_index.build(old, path)
    for low, high in ((3, 5), (5, 8)):
        text_index.add(mixed, mixed.lines.where(f"move_id >= {low} and move_id < {high}"), path)
    table = text_index.store(spark, path)
    before = {r.part: r.generation for r in table.entries().collect()}
    assert any("+" in p for p in before)
    wanted = {n: rows(ledger.ledger_search(mixed, move_name=n)) for n in ("inv", "aaa", "ab", "a")}
    assert {n: rows(text_index.ledger_search(mixed, path, move_name=n)) for n in wanted} == wanted
    text_index.merge(spark, path)
    after = {r.part: r.generation for r in table.entries().collect()}
    assert not any("+" in p for p in after) and {p for p in after if before.get(p) == after[p]}
    assert {n: rows(text_index.ledger_search(mixed, path, move_name=n)) for n in wanted} == wanted
    assert table.read().count() == table.read().distinct().count()


def test_a_search_reads_few_files(spark, tpch, tmp_path):
    path, stored = str(tmp_path / "index"), str(tmp_path / "lines")
    text_index.build(tpch, path)
    table = text_index.store(spark, path)
    hits = text_index.matching(spark, path, "move_name", "move/12")
    # five groups of three letters: as many parts, of the hundreds there are
    assert 0 < scanned(hits, "gram")[0] <= 5 < scanned(table.read(), "gram")[0] / 10
    assert {r.text for r in hits.collect()} == {r.name for r in tpch.moves.where("name like 'MOVE/12%'").collect()}
    text_index.write_lines(tpch, stored, files=16)
    books = replace(tpch, lines=spark.read.schema(tpch.lines.schema).parquet(stored))
    name = tpch.moves.where("id % 3 = 1").orderBy(F.desc("id")).first().name
    found = text_index.ledger_search(books, path, move_name=name)
    assert rows(found) == rows(ledger.ledger_search(books, move_name=name))
    ids = tpch.moves.where(F.col("name").contains(name)).select("id")
    one = text_index._restricted(books.lines, "move_id", ids, 10)
    assert 0 < one.count() and "PushedFilters: [In(move_id" in one._jdf.queryExecution().executedPlan().toString().replace("EqualTo(move_id", "In(move_id").replace("IsNotNull(move_id), ", "")
