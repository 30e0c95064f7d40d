"""The pipeline's stages against their operators' rules, and what is left when the subpackage isn't there."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb

import corpus_pipeline
from spanwood.llm.queries import QUERIES, SQL

ROOT = Path(__file__).resolve().parent.parent.parent


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from spanwood.llm.store import written

        docs = written(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert before is None or ids <= before, name
        before = ids
    pieces = corpus_pipeline.packing(spark, docs, sf_dir)
    assert {r.doc_id for r in pieces.collect()} == before
    total = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert 0.5 * total < len(before) < total
    leaked = {r.doc_id for r in QUERIES["op2_decontamination"](spark, sf_dir).collect()}
    assert leaked and not leaked & before


def test_queries_give_what_sql_gives(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name, sql in SQL.items():
        got, want = QUERIES[name](spark, sf_dir), con.sql(sql)
        order = want.columns
        assert sorted(map(str, (tuple(r) for r in got.select(order).collect()))) == sorted(map(str, want.fetchall())), name


def test_the_rest_works_without_it(tmp_path):
    for f in ("spanwood", "__spark_entry__.py"):
        source = ROOT / f
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / f)
    shutil.rmtree(tmp_path / "spanwood/llm")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') or x == 'pipeline' for x in q)"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
