import pytest
from pyspark.sql import functions as F

from spanwood.api import Forest
from spanwood.functions import columns as C
from spanwood.sources.binary import BinaryError, read_binary, read_hex, write_binary
from spanwood.sources.files import parse_bytes
from spanwood.sources.text import TextError, read_text
from spanwood.sources.xml import read_xml

TEXT = """DOC_:CONT:
	NUMB:UI32:7
	EMPT:CONT:
	END
	STRI:CSTR:"a\\"b\\\\c"
	WIDE:USTR:"é<&>"
	0x00000001:DATA:0x00FF
	FLOT:FP64:1.55000000000000000E+01
	FRAC:UR32:1/2
	CODE:FC32:'abcd'
	NOTH:NULL:
END
"""


@pytest.fixture
def forest(spark):
    return Forest.parse(spark.createDataFrame([("d", TEXT)], "id string, body string"), "id", "body")


def body(df):
    return df.first().body


def test_text_round_trip(forest):
    assert body(forest.to_text()) == TEXT


def test_binary_round_trip(spark, forest):
    data = bytes(body(forest.to_binary()))
    assert data == write_binary(read_text(TEXT)[0])
    assert int.from_bytes(data[:4], "big") == len(data)
    again = Forest.parse(spark.createDataFrame([("d", data)], "id string, body binary"), "id", "body")
    assert body(again.to_text()) == TEXT


def test_hex_round_trip(spark, forest):
    shown = body(forest.to_hex())
    assert shown.startswith("0x")
    assert body(Forest.parse(spark.createDataFrame([("d", shown)], "id string, body string"), "id", "body").to_text()) == TEXT


def test_xml_round_trip(forest):
    xml = body(forest.to_xml())
    assert '<atom name="WIDE" type="USTR" value="é&lt;&amp;&gt;"></atom>' in xml
    assert write_binary(read_xml(xml.encode())[0]) == write_binary(read_text(TEXT)[0])


def test_debug_lines_align(forest):
    lines = body(forest.to_debug()).splitlines()
    assert lines[1].endswith("00 00 00 07")
    width = max(len(r.text) for r in forest.nodes.collect()) + 1
    assert all(x[width - 1] == " " for x in lines if len(x) >= width)


def test_lengths(forest):
    lengths = {r.node_id: r.length for r in forest.lengths().collect()}
    assert lengths[0] == len(write_binary(read_text(TEXT)[0]))
    assert lengths[1] == 16
    assert lengths[2] == 12


def test_navigation(forest):
    top = forest.path("/DOC_")
    assert forest.children(top).count() == 9
    assert forest.descendants(top).count() == 10
    assert [r.n_children for r in forest.path("//EMPT").collect()] == [0]
    assert [r.n_children for r in forest.path("//NUMB").collect()] == [-1]
    assert body(forest.subtrees(forest.path("//NUMB")).to_text()) == "NUMB:UI32:7\n"


def test_hex_with_swapped_bytes():
    data = write_binary(read_text(TEXT.replace('\tSTRI:CSTR:"a\\"b\\\\c"\n', "").replace("\t0x00000001:DATA:0x00FF\n", ""))[0])
    assert len(data) % 2 == 0
    swapped = bytearray(data)
    swapped[::2], swapped[1::2] = data[1::2], data[::2]
    assert write_binary(read_hex(f"0x{swapped.hex()}\n")[0]) == data


def test_surplus_bytes_of_fixed_types_are_dropped():
    assert read_binary(bytes.fromhex("00000012") + b"NUMBUI32" + bytes.fromhex("000000070000"))[0].data == b"\0\0\0\7"


@pytest.mark.parametrize(
    "data",
    [bytes.fromhex("0000000b") + b"NUMBUI32", bytes.fromhex("ffffffff") + b"NUMBDATA1234", b"abc", bytes.fromhex("00000010") + b"NUMBXXXX1234", bytes.fromhex("00000014") + b"CONTCONT" + bytes.fromhex("00000010") + b"NUMBUI32" + b"\0\0\0\1", bytes.fromhex("0000000e") + b"NUMBUI32ab"],
)
def test_bad_binary(data):
    with pytest.raises(BinaryError):
        read_binary(data)


def test_cut_container():
    data = write_binary(read_text("TREE:CONT:\nNUMB:UI32:1\nNUMB:UI32:2\nEND\n")[0])[:-16]
    assert len(read_binary(data)[0].children) == 1
    with pytest.raises(BinaryError):
        read_binary(data, strict=True)


@pytest.mark.parametrize("text", ["NUM:UI32:1", "END", "NUMB:UI32:x", "NUMB:UI32", "TREE:CONT:1", 'NAME:CSTR:abc', "FRAC:UR32:1/0", "CODE:FC32:'abcde'", "ADDR:IPAD:\"\"", "NUMB:XXXX:1"])
def test_bad_text(text):
    with pytest.raises(TextError, match="line 1"):
        read_text(text)


def test_unclosed_container_is_no_tree():
    assert read_text("TREE:CONT:\nNUMB:UI32:1\n") == []


def test_form_is_told_by_content():
    node = read_text(TEXT)[0]
    data = write_binary(node)
    for content in (data, f"0x{data.hex()}".encode(), TEXT.encode()):
        assert write_binary(parse_bytes(content)[0]) == data


def test_bad_files_as_rows(spark):
    df = spark.createDataFrame([("good", b"NUMB:UI32:1\n"), ("bad", b"NUMB:UI32:x\n")], "id string, body binary")
    rows = {r.doc_id: r.error for r in Forest.parse(df, "id", "body", errors="row").nodes.collect()}
    assert rows["good"] is None and "line 1" in rows["bad"]


def test_files_and_streams(spark, tmp_path):
    from spanwood.streaming.files import read_node_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(TEXT)
    (tmp_path / "in/b.bin").write_bytes(write_binary(read_text(TEXT)[0]))
    assert Forest.read(spark, f"{tmp_path}/in").path("//NUMB").count() == 2
    stream = Forest(read_node_stream(spark, f"{tmp_path}/in"))
    q = stream.path("//NUMB[@data = 7]").select("doc_id", "text").writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").count() == 2


def test_columns_agree_with_the_codec(spark):
    from spanwood.functions import codec

    cases = [("UI64", "ffffffffffffffff"), ("SI08", "80"), ("SI64", "fffffffffffffff6"), ("FP32", "c0490fdb"), ("FP64", "0000000000000001"), ("FP64", "7ff0000000000000"), ("FP64", "c00921fb54442d18"), ("UF32", "0001ffff"), ("SF64", "fffffffe80000000"), ("UR64", "ffffffff00000002"), ("SR32", "ffff0002"), ("FC32", "61626364"), ("FC32", "23626364"), ("FC32", "61276364"), ("ENUM", "ffffffff"), ("UUID", "00112233445566778899aabbccddeeff"), ("IP32", "0a0000010a000002"), ("CSTR", "616200"), ("USTR", "000000e9"), ("DATA", "00ff")]
    for code, data in cases:
        got = spark.createDataFrame([(bytes.fromhex(data),)], "d binary").select(C.value(code, F.col("d")).alias("v")).first().v
        want = codec.decode(code, bytes.fromhex(data))
        want = next(x for x in (want.u, want.i, want.f, want.s) if x is not None)
        assert (int(got) if isinstance(want, int) else got) == want, (code, data)


def test_sql_functions(spark):
    from spanwood.api import register

    register(spark)
    spark.createDataFrame([("d", TEXT.encode())], "id string, body binary").createOrReplaceTempView("contents")
    found = spark.sql("SELECT n.* FROM contents, LATERAL parse_nodes(id, body, 'text') n")
    assert Forest(found).path("/DOC_[NUMB = 7]").count() == 1
    assert spark.sql("SELECT node_text('UI32', node_data('UI32', '0x10'))").first()[0] == "16"


def test_nodes_from_values(spark):
    from spanwood.sources.tree import make

    node = make("DOC_", "CONT", children=[make("NUMB", "UI32", 7), make("STRI", "CSTR", "x"), make("ZERO", "SI64"), make("0x00000001", "UR32", (1, 2))])
    df = spark.createDataFrame([("d", write_binary(node))], "id string, body binary")
    assert body(Forest.parse(df, "id", "body").to_text()) == 'DOC_:CONT:\n\tNUMB:UI32:7\n\tSTRI:CSTR:"x"\n\tZERO:SI64:0\n\t0x00000001:UR32:1/2\nEND\n'
    with pytest.raises(ValueError):
        make("NUMB", "UI32", 1, [node])
    with pytest.raises(ValueError, match="cannot use type"):
        make("NUMB", "UI32", 1.5)


def test_attribute_table(spark):
    from spanwood.operators.navigate import attribute_table

    cells = lambda name, code, values: f"{name}:CONT:\nAVTP:FC32:'{code}'\nAVAL:CONT:\n" + "".join(f"0x{i:08X}:{code}:{v}\n" for i, v in enumerate(values)) + "END\nEND\n"
    text = "BUND:CONT:\nBVER:UI32:1\n" + cells("IDEN", "UI32", [5, 6]) + cells("NAME", "CSTR", ['"a"', '"b"']) + "END\n"
    nodes = Forest.parse(spark.createDataFrame([("d", text)], "id string, body string"), "id", "body").nodes
    assert sorted((r.row, r.IDEN, r.NAME) for r in attribute_table(nodes, ["IDEN", "NAME"]).collect()) == [(0, "5", "a"), (1, "6", "b")]


def test_command_line(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    (tmp_path / "in.txt").write_text(TEXT)
    run = lambda *a: subprocess.run([sys.executable, "-m", "spanwood", *a], cwd=root, capture_output=True, text=True, timeout=120)
    assert run("build", f"{tmp_path}/in.txt", f"{tmp_path}/out.bin").returncode == 0
    shown = run("show", "-p", "/DOC_/NUMB", f"{tmp_path}/out.bin")
    assert shown.stdout == "NUMB:UI32:7\n", shown.stderr
