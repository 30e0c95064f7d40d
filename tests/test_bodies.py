"""Documents written straight from tables, and records read straight from documents, against the node table's ways."""

import math

import pytest
from pyspark.sql import functions as F

from spanwood.api import Forest
from spanwood.operators.bodies import writable
from spanwood.queries import QUERIES
from spanwood.sources.files import parse_column
from spanwood.sources.scan import Unplain, read_records, scan_binary, scan_hex, scan_text, scan_xml
from spanwood.sources.tables import Field, Rows
from spanwood.sources.text import read_text
from spanwood.sources.binary import write_binary

FIELDS = {"part": ("PKEY", "i"), "quantity": ("QTY_", "f")}
ODD = ['a"b\\c', "é\n\t<&>'", "", None, "\x01\x7f", "plain", "\r", "x" * 5000]


def forest(spark, keys=tuple(range(1, 9)), lines=None, null=None):
    tops = spark.createDataFrame([(k, ODD[k % 8], k * 0.1 if k % 3 else math.nan) for k in keys], "k long, s string, f double")
    lines = [(1 + j % 7, j, ODD[j % 8], null if j % 5 == 0 else j - 20, j / 7 if j % 4 else None) for j in range(60)] if lines is None else lines
    rows = spark.createDataFrame(lines, "k long, n int, s string, b long, f double")
    line = [Field("NUMB", "UI32", F.col("n")), Field("STRI", "CSTR", F.col("s")), Field("PKEY", "SI64", F.col("b")), Field("QTY_", "FP64", F.col("f"))]
    top = [Field("OKEY", "SI64", F.col("k")), Field("STAT", "CSTR", F.col("s")), Field("TOTL", "FP64", F.col("f"))]
    return Forest.of_table("ORDR", tops, F.col("k"), top, Rows("LINE", rows, F.col("k"), ["n"], line))


def bodies(df):
    return sorted((r.doc_id, r.root_ord, bytes(r.body) if isinstance(r.body, bytearray) else r.body) for r in df.collect())


@pytest.mark.parametrize("form", ["text", "binary", "hex", "xml"])
def test_tables_are_written_as_their_nodes_are(spark, form):
    f = forest(spark, null=None if form in ("text", "xml") else 0)  # the node table can't give a null integer's bytes
    assert writable(f.tree)
    assert bodies(getattr(f, f"to_{form}")()) == bodies(getattr(Forest(f.nodes), f"to_{form}")())


def test_tables_without_child_rows_are_written_as_their_nodes_are(spark):
    tops = spark.createDataFrame([(k, ODD[k]) for k in range(8)], "k int, s string")
    f = Forest.of_table("PART", tops, F.col("k"), [Field("PKEY", "SI08", F.col("k") - 4), Field("PNAM", "CSTR", F.col("s"))])
    assert bodies(f.to_binary()) == bodies(Forest(f.nodes).to_binary())
    assert bodies(f.to_text()) == bodies(Forest(f.nodes).to_text())


def test_repeated_documents_have_all_lines_and_lone_lines_none(spark):
    f = forest(spark, (5, 5, 6), [(5, 2, "b", 2, 2.0), (5, 1, "a", 1, 1.0), (99, 1, "c", 3, 3.0), (None, 1, "d", 4, 4.0)])
    found = read_records(f.to_binary(), "doc_id", "body", "binary", ["ORDR", "LINE"], FIELDS)
    assert sorted(map(tuple, found.collect())) == [("5", 1, 1.0), ("5", 1, 1.0), ("5", 2, 2.0), ("5", 2, 2.0)]


def test_a_document_of_many_batches(spark):
    f = forest(spark, (1, 2, 3), [(2, j, "s", j, float(j)) for j in range(25_000)] + [(3, 1, "s", 7, 7.0)])
    for form in ("text", "binary"):
        found = read_records(getattr(f, f"to_{form}")(), "doc_id", "body", form, ["ORDR", "LINE"], FIELDS)
        assert sorted((r.doc_id, r.part, r.quantity) for r in found.collect()) == [("2", j, float(j)) for j in range(25_000)] + [("3", 7, 7.0)]


def test_a_line_without_values_is_a_record(spark):
    f = forest(spark, (1,), [(1, 1, "a", None, None), (1, 2, "b", 2, 2.0)])
    for form in ("text", "binary"):
        found = read_records(getattr(f, f"to_{form}")(), "doc_id", "body", form, ["ORDR", "LINE"], FIELDS)
        assert sorted(map(tuple, found.collect()), key=repr) == [("1", 2, 2.0), ("1", None, None)]


def test_values_beyond_their_type_are_errors(spark):
    tops = spark.createDataFrame([(1, 1 << 32, math.inf)], "k long, n long, f double")
    for field in (Field("NUMB", "UI32", F.col("n")), Field("FLOT", "FP64", F.col("f"))):
        with pytest.raises(Exception, match="exceeds range"):
            Forest.of_table("PART", tops, F.col("k"), [field]).to_binary().collect()


TREES = [
    "ORDR:CONT:\n\tLINE:CONT:\n\t\tPKEY:SI64:1\n\t\tQTY_:FP64:2.50000000000000000E+00\n\tEND\n\tLINE:CONT:\n\tEND\nEND\n",
    "# a comment\nORDR:CONT:\nLINE:CONT:\n  PKEY:SI64:-0x10\n PKEY:SI64:+007\nPKEY:SI64:-3\nEND\nEND\n",
    'ORDR:CONT:\n\tSTAT:CSTR:"a\\"b\\\\"\n\tLINE:CONT:\n\t\tQTY_:FP64:1e3\n\t\tPKEY:CSTR:"x"\n\tEND\n\tPKEY:SI64:9\nEND\n',
    'ORDR:CONT:\n\tSTAT:CSTR:"é"\n\tLINE:CONT:\n\t\tLINE:CONT:\n\t\t\tPKEY:SI64:4\n\t\tEND\n\t\tPKEY:SI32:5\n\tEND\nEND\n',
    "ORDR:CONT:\n\tLINE:CONT:\n\t\tPKEY:SI64:010\n\t\tQTY_:FP32:1.1\n\t\t0x00000001:DATA:0x00FF\n\tEND\n\tUNSI:UI64:18446744073709551615\nEND\n",
    "OTHR:CONT:\n\tLINE:CONT:\n\t\tPKEY:SI64:1\n\tEND\nEND\n",
    "PKEY:SI64:1\n",
    "ORDR:CONT:\n\tLINE:CONT:\n\t\tPKEY:SI64:-9223372036854775808\n\t\tQTY_:FP64:-0.00000000000000000E+00\n\tEND\nEND\n",
]


def documents(spark, form, trees=TREES * 20):
    parsed = Forest.parse(spark.createDataFrame([(str(k), t) for k, t in enumerate(trees)], "id string, body string"), "id", "body")
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(trees)], "doc_id string, body string") if form == "text" else getattr(parsed, f"to_{form}")()


@pytest.mark.parametrize("form", ["text", "binary", "hex", "xml"])
def test_records_are_those_of_the_node_table(spark, form):
    df = documents(spark, form).select("doc_id", "body").coalesce(1)
    again = Forest(parse_column(df, "doc_id", "body", form, exactly_one=True))
    nodes = again.path("/ORDR/LINE/*").unionByName(again.path("/ORDR/LINE").withColumn("parent_id", F.col("node_id")))
    most = lambda name, column: F.max(F.when(F.col("name") == name, F.col(column)))
    want = nodes.groupBy("doc_id", "parent_id").agg(most("PKEY", "i").alias("part"), most("QTY_", "f").alias("quantity")).select("doc_id", "part", "quantity")
    got = read_records(df, "doc_id", "body", form, ["ORDR", "LINE"], FIELDS)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


@pytest.mark.parametrize(
    "form, body",
    [("text", "ORDR:CONT:\n\tPKEY:SI08:128\nEND\n"), ("text", "ORDR:CONT:\n\tQTY_:FP64:inf\nEND\n"), ("text", "ORDR:CONT:\n\tSTAT:CSTR:abc\nEND\n"), ("text", "ORDR:CONT:\nEND\nORDR:CONT:\nEND\n"), ("text", "ORDR:CONT:\n"), ("text", ""), ("xml", '<?xml version="1.0" encoding="UTF-8"?>\n<containerxml version="1">\n\t<container name="ORDR">\n</containerxml>\n'), ("hex", "0x0000000C4F52445243"), ("hex", "0x000000154F524452435354524162630044")],
)
def test_documents_that_are_wrong_stay_errors(spark, form, body):
    df = spark.createDataFrame([("good", documents(spark, form, TREES[:1]).first().body), ("bad", body)], "doc_id string, body string").coalesce(1)
    with pytest.raises(Exception, match="bad: "):
        read_records(df, "doc_id", "body", form, ["ORDR", "LINE"], FIELDS).collect()


def test_plain_documents_are_scanned(spark):
    import numpy as np

    data = write_binary(read_text(TREES[0])[0])
    xml = documents(spark, "xml", TREES[:1]).first().body.encode()
    for scan, one in ((scan_text, TREES[0].encode()), (scan_binary, data), (scan_hex, b"0x" + data.hex().encode()), (scan_xml, xml)):
        nodes = scan(np.frombuffer(one * 3, np.uint8), np.arange(4) * len(one))
        assert nodes.depth.tolist() == [0, 1, 2, 2, 1] * 3 and nodes.parent.tolist() == [-1, 0, 1, 1, 0, -1, 5, 6, 6, 5, -1, 10, 11, 11, 10]
        assert nodes.values["i"][[2, 7, 12]].tolist() == [1, 1, 1] and nodes.values["f"][[3, 8, 13]].tolist() == [2.5] * 3
        with pytest.raises(Unplain):
            scan(np.frombuffer(one[:-1], np.uint8), np.array([0, len(one) - 1]))


@pytest.mark.parametrize("form", ["text", "binary", "hex", "xml"])
def test_round_trips_shuffle_rows_once(spark, sf_dir, form):
    plan = QUERIES[f"{form}_roundtrip"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Aggregate" not in plan


def test_lengths_are_those_of_what_is_written(spark):
    f = forest(spark)
    want = {(r.doc_id, len(r.body)) for r in f.to_binary().collect()}
    assert {(r.doc_id, r.length) for r in f.document_lengths().collect()} == want
    assert {(r.doc_id, r.length) for r in Forest(forest(spark, null=0).nodes).document_lengths().collect()} == {(r.doc_id, len(r.body)) for r in forest(spark, null=0).to_binary().collect()}
    twice = forest(spark, (5, 5, 6), [(5, 1, "a", 1, 1.0), (99, 1, "c", 3, 3.0), (None, 1, "d", 4, 4.0)])
    assert sorted((r.doc_id, r.length) for r in twice.document_lengths().collect()) == sorted((r.doc_id, len(r.body)) for r in twice.to_binary().collect())


def test_lengths_check_values_as_writing_does(spark):
    tops = spark.createDataFrame([(1, 1 << 32, math.inf)], "k long, n long, f double")
    for field in (Field("NUMB", "UI32", F.col("n")), Field("FLOT", "FP64", F.col("f"))):
        with pytest.raises(Exception, match="exceeds range"):
            Forest.of_table("PART", tops, F.col("k"), [field]).document_lengths().collect()


def test_lengths_need_no_nodes(spark, sf_dir):
    plan = QUERIES["marshal_len"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2 and "Window" not in plan and "Python" not in plan
