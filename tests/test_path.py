import pytest
from pyspark.errors import SparkRuntimeException

from spanwood.api import Forest
from spanwood.plans.syntax import PathError, parse

GRID = """# a grid of leaves
TREE:CONT:
	ROW1:CONT:
		LEAF:UI32:1
		LEAF:UI32:2
		LEAF:UI32:3
	END
	ROW2:CONT
		LEAF:UI32:4
		LEAF:UI32:5
		LEAF:UI32:6
	END
END
"""
TYPED = """VALS:CONT:
	U__1:UI64:1
	UMAX:UI64:18446744073709551615
	S__P:SI64:10
	S__N:SI64:-10
	F__P:FP64:1.55E+01
	F__N:FP64:-1.55E+01
	TEXT:CSTR:"Word"
	0x00000001:UI32:7
END
"""


@pytest.fixture(scope="module")
def forest(spark):
    df = spark.createDataFrame([("grid", GRID), ("typed", TYPED)], "id string, body string")
    f = Forest.parse(df, "id", "body", "text", exactly_one=True)
    return Forest(f.nodes.cache())


def found(forest, path, doc="grid"):
    return [r.text.rpartition(":")[2] or r.text.split(":")[0] for r in forest.ordered(path).collect() if r.doc_id == doc]


GRID_CASES = [
    ("/", "TREE"),
    ("/TREE", "TREE"),
    ("TREE/ROW2", "ROW2"),
    ("//LEAF", "1 2 3 4 5 6"),
    ("//leaf", ""),
    ("//*", "TREE ROW1 1 2 3 ROW2 4 5 6"),
    ("/TREE/*/LEAF", "1 2 3 4 5 6"),
    ("/TREE/*/LEAF[4]", "4"),
    ("/TREE/*/LEAF[0]", ""),
    ("/TREE/ROW1/LEAF[last()]", "3"),
    ("//LEAF[1 + 1]", "2"),
    ("//LEAF[2+-1]", "1"),
    ("//LEAF[3 + 4 * 2 div (1 - 5)]", "1"),
    ("//LEAF[position() le last() div 2]", "1 2 3"),
    ("//LEAF[position() > 1][position() > 1][1]", "3"),
    ("//LEAF[@data mod 2 = 0]", "2 4 6"),
    ("//LEAF[@data idiv 2 = 1]", "2 3"),
    ("//LEAF[@data = 2 or @data = 5]", "2 5"),
    ("//LEAF[not(@data > 2) and true()]", "1 2"),
    ("//LEAF[false()]", ""),
    ("//LEAF[@name = 'leaf'][2]", "2"),
    ("//LEAF[@name_hex = '0x4C454146'][1]", "1"),
    ("//*[type() = CONT]", "TREE ROW1 ROW2"),
    ("/TREE/ROW1/LEAF | /TREE/ROW2/LEAF", "4 5 6 1 2 3"),
    ("(/TREE/ROW1/LEAF union /TREE/ROW2/LEAF)[1]", "4"),
    ("//LEAF | //LEAF", "1 2 3 4 5 6 1 2 3 4 5 6"),
    ("//LEAF intersect /TREE/ROW2/*", "4 5 6"),
    ("/TREE/*[LEAF = 4]", "ROW2"),
    ("/TREE/ROW1//LEAF[5]", "5"),
    ("//LEAF[010]", ""),
    ("//LEAF[0x3]", "3"),
    ("//NONE[1 = 'x' + 2]", ""),
]


@pytest.mark.parametrize("path,want", GRID_CASES)
def test_grid(forest, path, want):
    assert found(forest, path) == want.split()


@pytest.mark.parametrize(
    "predicate,want",
    [
        ("U__1 = 1", True),
        ("U__1 = '1'", True),
        ("'1' = U__1", True),
        ("S__N = '-10'", True),
        ("F__P = '15.5'", True),
        ("'15.5' = F__P", True),
        ("UMAX = U__1", False),
        ("UMAX = -1", True),
        ("TEXT = 'wORD'", True),
        ("TEXT != 'word'", False),
        ("NONE = 'none'", True),
        ("S__N < U__1", True),
        ("F__N lt F__P", True),
        ("F__P >= 15.5", True),
        ("UMAX > 10.5", True),
        ("TEXT < 'Aaaa'", True),
        ("U__1 + S__N = -9", True),
        ("UMAX + U__1 = 0", True),
        ("S__P div 4 = 2.5", True),
        ("S__N idiv 4 = -2", True),
        ("S__N mod 4 = -2", True),
        ("F__P mod 4 = 3.5", True),
        ("U__1 div 0 > 1000000", True),
        ("true() = U__1", True),
    ],
)
def test_coercions(forest, predicate, want):
    assert bool(found(forest, f"/VALS[{predicate}]", "typed")) is want


def test_hex_names_compare_as_numbers(forest):
    assert found(forest, "/VALS/*[@name > 0]", "typed") == ["7"]


def test_strict_string_order(forest):
    assert forest.path("/VALS[TEXT < 'Aaaa']", strict_less=True).count() == 0


@pytest.mark.parametrize(
    "path,message",
    [
        ("", "invalid path: <empty>"),
        ("/TREE/", "operator '/' must be followed by element name or *"),
        ("//", "operator '//' must be followed by element name or *"),
        ("TREE[64/8]", "operator '/' is not valid within predicate"),
        ("TREE[]", "empty predicate"),
        ("TREE[what()]", 'unrecognized function "what"'),
        ("(TREE", "mismatched parentheses"),
        ("TREE)", "mismatched parentheses"),
        ("TREE[1", "isn't closed"),
        ("TREE['a]", "unterminated string"),
        ("TREE except ROW1", "unexpected token"),
        ("TREE[-0x10 = 1]", "invalid numeric value"),
    ],
)
def test_errors_in_paths(path, message):
    with pytest.raises(PathError) as e:
        parse(path)
    assert message in str(e.value)


@pytest.mark.parametrize(
    "predicate,message",
    [
        ("not(last())", "expect boolean, got 'last'"),
        ("64 odd 8", "unrecognized token 'odd'"),
        ("'text'", "unrecognized token 'text'"),
        ("1 and 2", "expect boolean, got '1'"),
        ("@type + 1 = 2", "expected numeric value"),
        ("5 idiv 0", "integer divide by zero"),
        ("@nothing = 1", "unknown variable: @nothing"),
    ],
)
def test_errors_of_candidates(forest, predicate, message):
    with pytest.raises(SparkRuntimeException) as e:
        forest.path(f"/TREE[{predicate}]").collect()
    assert message in str(e.value)
    assert forest.path(f"//NONE[{predicate}]").collect() == []


def test_leading_descendant_is_a_plain_scan(spark, sf_dir):
    from spanwood.queries import orders

    plan = orders(spark, sf_dir).path("//QTY_[@data > 45]").select("doc_id", "f")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Union" not in plan
    assert "GreaterThan(l_quantity,45.0)" in plan
