"""The pipeline's stages against plain loops, on the test data and on edge cases."""

from __future__ import annotations

import os
import subprocess
import sys

import brute
from test_corpus_operators import check_packing, tokenizer  # noqa: F401

import __spark_entry__
import corpus_pipeline
from ledgerloom.llm import quality_rules
from ledgerloom.llm.queries import QUERIES


def by_stage(spark, docs, sf_dir, folder):
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs)
    return out


def expected(rows, hosts, items):
    """What each of the first four stages keeps, as (key, text) in order of key."""
    kept = brute.kept_by_rules([(t, hosts[i]) for i, t in rows])
    stages = [[row for row, stays in zip(rows, kept) if stays]]
    fps = [brute.fingerprint(t) for _, t in stages[0]]
    roots = brute.components(fps)
    stages.append([row for k, row in enumerate(stages[0]) if roots[k] == k])
    cut = brute.deduplicated(stages[1], over_blanks=True)
    stages.append([(i, cut[i][0]) for i, _ in stages[1] if not cut[i][1] or brute.solid(cut[i][0])])
    phrases = brute.windows(items)
    stages.append([(i, t) for i, t in stages[2] if not brute.contaminated(t, phrases)[1]])
    return stages


def test_stages(spark, sf_dir, docs, texts, tokenizer, tmp_path):  # noqa: F811
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = by_stage(spark, docs, sf_dir, tmp_path)
    want = expected(sorted(texts.items()), {r.doc_id: r.source for r in docs.collect()}, items)
    for frame, rows in zip(found, want):
        assert frame.columns == docs.columns
        assert sorted((r.doc_id, r.text) for r in frame.collect()) == rows
        assert all(r.n_chars == len(r.text) for r in frame.collect())
    assert len(docs.collect()) > len(want[0]) > len(want[1]) >= len(want[2]) > len(want[3])
    check_packing(found[4].collect(), want[3], tokenizer)
    same = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    total = lambda rows: sum(n for _, _, n, _ in same(rows))
    assert total(corpus_pipeline.run(spark, sf_dir).collect()) == total(found[4].collect())


def test_stages_of_edge_cases(spark, sf_dir, edge, tmp_path):
    found = by_stage(spark, edge, sf_dir, tmp_path)
    assert all(frame.columns == edge.columns for frame in found[:4])
    ids = [sorted((r.doc_id for r in frame.collect()), key=str) for frame in found[:4]]
    assert ids[0].count(None) == 2 and ids[1].count(None) == 1 and 8 in ids[3]
    assert found[4].count() > 0


def test_stages_of_an_empty_table(spark, sf_dir, empty, tmp_path):
    assert [frame.count() for frame in by_stage(spark, empty, sf_dir, tmp_path)] == [0] * 5


def test_registered():
    names = set(__spark_entry__.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= names


def test_host_evidence_rejects_documents_that_pass_the_base_rules(spark, sf_dir, docs):
    rows = docs.collect()
    kept = dict(zip((r.doc_id for r in rows), brute.kept_by_rules([(r.text, r.source) for r in rows])))
    found = quality_rules.op4_quality_rules(spark, sf_dir).collect()
    assert {r.doc_id: r.kept for r in found} == kept
    assert any(not r.base_failed and not r.kept for r in found)


def test_rows_without_a_key_change_no_other_rows_stages(spark, sf_dir, docs, tmp_path):
    """One null id and one repeated id more: what the first four stages do to all others stays the same."""
    more = spark.createDataFrame([(None, "no id " * 3, "en", "src1", 1), (10**9, "one", "en", "src1", 1), (10**9, "two", "en", "src1", 1)], docs.schema)
    made = []
    for n, own in enumerate((docs, docs.unionByName(more).repartition(7))):
        frames = by_stage(spark, own, sf_dir, tmp_path / str(n))[:4]
        made.append([sorted((r.doc_id, r.text) for r in f.where("doc_id < 1000000").collect()) for f in frames])
    assert made[0] == made[1]


def test_interleaved_runs_leave_each_others_tables(spark, sf_dir, docs, tmp_path):
    """Two pipelines by turns in one driver, on folders of their own."""
    folders = []
    for n in (1, 2):
        (tmp_path / f"sf{n}").mkdir()
        for table in ("documents", "benchmark"):
            os.symlink(f"{sf_dir}/{table}.parquet", tmp_path / f"sf{n}" / f"{table}.parquet")
        folders.append(str(tmp_path / f"sf{n}"))
    frames = [docs, docs]
    for _, stage in corpus_pipeline.STAGES[:3]:
        frames = [stage(spark, frame, folder) for frame, folder in zip(frames, folders)]  # lazy until both have begun
        for n, frame in enumerate(frames):
            frame.write.parquet(path := str(tmp_path / f"out{n}-{stage.__name__}"))
            frames[n] = spark.read.parquet(path)
    assert sorted(r.doc_id for r in frames[0].collect()) == sorted(r.doc_id for r in frames[1].collect())


def test_the_rest_imports_without_this_folder(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for name in ("__spark_entry__.py", "ledgerloom"):
        subprocess.run(["cp", "-r", f"{root}/{name}", tmp_path], check=True)
    (tmp_path / "ledgerloom" / "llm").rename(tmp_path / "gone")
    code = "import __spark_entry__ as e; assert not any(n.startswith('op') for n in e.queries()) and 'general_ledger' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})

