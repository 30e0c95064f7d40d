"""Every query of the library's own that SQL can express, against DuckDB on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

from spanwood.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def shown(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in (r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", SQL)
def test_query_gives_what_sql_gives(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir), duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got.collect(), got.columns) == shown(want.fetchall(), want.columns)


def test_entry_module_needs_no_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries().keys() >= e.oracle_sql().keys()"], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", ["data_hex", "cstr_roundtrip", "ustr_roundtrip"])
def test_odd_texts_give_what_sql_gives(spark, tmp_path, name):
    texts = ["", None, "a", "é<&>", "\U0001f600", "\ufeffa", "\ufffe", "a\nb", "x" * 70_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = QUERIES[name](spark, str(tmp_path)).select("id", "value").collect(), con.sql(SQL[name]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_wide_strings_need_no_worker(spark, sf_dir):
    assert "Python" not in QUERIES["ustr_roundtrip"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_wide_strings_agree_with_the_codec(spark):
    from pyspark.sql import functions as F

    from spanwood.functions import codec
    from spanwood.functions import columns as C

    points = ["", "00000061", "0000FEFF00000061", "FFFE0000", "0000D800", "0000DFFF00000041", "00110000", "0010FFFF", "FFFFFFFF0001F600", "0000FFFE", "00000000", "0000E000" * 3, "00000041" * 50_000 + "0000DC00"]
    df = spark.createDataFrame([(k, bytes.fromhex(p)) for k, p in enumerate(points)] + [(99, None)], "k int, d binary")
    got = dict(df.select("k", C.wide_string_value(F.col("d"))).collect())
    assert got == {99: None, **{k: codec.decode("USTR", bytes.fromhex(p)).s for k, p in enumerate(points)}}
    assert spark.createDataFrame([("\ufeffa\U0001f600",)], "s string").select(C.wide_string(F.col("s"))).first()[0] == "\ufeffa\U0001f600".encode("utf-32-be")
    with pytest.raises(Exception, match="multiple of 4"):
        spark.createDataFrame([(b"abc",)], "d binary").select(C.wide_string_value(F.col("d"))).collect()
