"""The node types: width in bytes, kind of value in a path expression, and the flattened table's schema."""

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class NodeType(NamedTuple):
    code: str
    width: int | None  # bytes of data; None where it varies
    family: str
    kind: str  # u, i, f or s: what @data is in a path expression


#: Code, width, family and kind of every type.
TYPES = {
    t.code: t
    for t in [
        NodeType("UI01", 4, "bool", "u"),
        *(NodeType(f"UI{8 * n:02}", n, "unsigned", "u") for n in (1, 2, 4, 8)),
        *(NodeType(f"SI{8 * n:02}", n, "signed", "i") for n in (1, 2, 4, 8)),
        *(NodeType(f"FP{8 * n}", n, "float", "f") for n in (4, 8)),
        *(NodeType(f"UF{8 * n}", n, "unsigned fixed", "f") for n in (4, 8)),
        *(NodeType(f"SF{8 * n}", n, "signed fixed", "f") for n in (4, 8)),
        *(NodeType(f"UR{8 * n}", n, "unsigned fraction", "s") for n in (4, 8)),
        *(NodeType(f"SR{8 * n}", n, "signed fraction", "s") for n in (4, 8)),
        NodeType("FC32", 4, "four chars", "s"),
        NodeType("ENUM", 4, "enum", "s"),
        NodeType("UUID", 16, "uuid", "s"),
        NodeType("IP32", None, "ip", "s"),
        NodeType("IPAD", None, "ip text", "s"),
        NodeType("CSTR", None, "c string", "s"),
        NodeType("USTR", None, "utf-32 string", "s"),
        *(NodeType(c, None, "bytes", "s") for c in ("DATA", "CNCT", "cnct")),
        NodeType("NULL", 0, "null", "s"),
        NodeType("CONT", None, "container", "s"),
    ]
}
KINDS = {k: [t.code for t in TYPES.values() if t.kind == k] for k in "uifs"}

_LONG, _INT, _STRING = T.LongType(), T.IntegerType(), T.StringType()
NODES = T.StructType(
    [
        T.StructField(name, kind)
        for kind, names in [
            (_STRING, "doc_id"),
            (_INT, "root_ord"),
            (_LONG, "node_id parent_id"),
            (_INT, "child_ord depth"),
            (_LONG, "last_desc"),
            (T.ArrayType(_STRING), "path"),
            (_STRING, "name"),
            (_LONG, "name_u32"),
            (_STRING, "type"),
            (_INT, "n_children"),
            (T.BinaryType(), "data"),
            (T.DecimalType(20, 0), "u"),
            (_LONG, "i"),
            (T.DoubleType(), "f"),
            (_STRING, "s text"),
        ]
        for name in names.split()
    ]
)
#: Columns that name a document: every operator works within one.
DOCUMENT = ["doc_id", "root_ord"]


def kind_of(type_: Column) -> Column:
    """u, i, f or s; folds away where the type is a literal."""
    return F.when(type_.isin(KINDS["u"]), "u").when(type_.isin(KINDS["i"]), "i").when(type_.isin(KINDS["f"]), "f").otherwise("s")


def name_of(raw: bytes) -> str:
    """A name's or code's four bytes as they are shown."""
    plain = all(0x21 <= b <= 0x7E and b not in b"\"'" for b in raw) and raw[:1] != b"#"
    return raw.decode("ascii") if plain else f"0x{raw.hex().upper()}"


def raw_of(name: str) -> bytes:
    """The four bytes that a shown name stands for."""
    if len(name) == 10 and name[:2] in ("0x", "0X"):
        return bytes.fromhex(name[2:])
    raw = name.encode("latin-1")
    if len(raw) != 4:
        raise ValueError(f'invalid string value for type FC32: "{name}"')
    return raw
