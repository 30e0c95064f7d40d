"""Relational tables as node trees: one document a row, with its fields and, in order, containers of child rows.

Each field is its own projection of the table, and the node table is their union. A path that names a node prunes all
other branches while the plan is made, so what is left is a plain scan of the columns that the path needs; numbering
windows and counts vanish where no step or position asks for them.
"""

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..types import NODES, TYPES, raw_of


@dataclass
class Field:
    name: str
    type: str
    value: Column


@dataclass
class Rows:
    """Child rows: each becomes a container called name, in the order of `order` within its document."""

    name: str
    table: DataFrame
    key: Column
    order: list
    fields: list[Field] = field(default_factory=list)


@dataclass
class Tree:
    """One document for each row of table."""

    name: str
    table: DataFrame
    key: Column
    fields: list[Field]
    rows: Rows | None = None


def _node(df: DataFrame, name: str, code: str, value: Column | None, node_id: Column, parent: Column | None, place: Column, path: list[str], last: Column, n_children: Column) -> DataFrame:
    """One branch. df has the column doc_id."""
    kind = TYPES[code].kind
    null = {f.name: F.lit(None).cast(f.dataType) for f in NODES}
    typed = dict(zip("uifs", (null["u"], null["i"], null["f"], null["s"])))
    v = value
    if code == "CONT":
        typed["s"], shown, data = F.lit(""), F.lit(""), F.lit(b"")
    elif kind in "ui":
        typed[kind] = v.cast("decimal(20,0)" if kind == "u" else "bigint")
        shown, data = v.cast("string"), C.big_endian(v, TYPES[code].width)
    elif code in ("FP32", "FP64"):
        typed["f"] = v.cast("double")
        shown, data = C.float_text(F.lit(code), v.cast("double")), C.float_data(F.lit(code), v.cast("double"))
    elif code in ("CSTR", "USTR"):
        typed["s"], shown = v, C.escaped(v)
        data = C.c_string(v) if code == "CSTR" else C.wide_string(v)
    else:
        shown = v.cast("string")
        data = C.encode_text(F.lit(code), shown)
        decoded = C.value(code, data)
        typed[kind] = decoded
    made = {
        "doc_id": F.col("doc_id"),
        "root_ord": F.lit(0),
        "node_id": node_id,
        "parent_id": parent if parent is not None else null["parent_id"],
        "child_ord": place,
        "depth": F.lit(len(path) - 1),
        "last_desc": last,
        "path": F.array(*map(F.lit, path)),
        "name": F.lit(name),
        "name_u32": F.lit(int.from_bytes(raw_of(name), "big")),
        "type": F.lit(code),
        "n_children": n_children,
        "data": data,
        **typed,
        "text": F.concat(F.lit(f"{name}:{code}:"), shown),
    }
    return df.select(*(made[f.name].cast(f.dataType).alias(f.name) for f in NODES))


def tree_of(name: str, table: DataFrame, key: Column, fields: list[Field], rows: Rows | None = None) -> DataFrame:
    """The flattened node table of one document for each row of table."""
    k = len(fields)
    m = len(rows.fields) + 1 if rows else 0
    base = table.select("*", key.cast("string").alias("doc_id"))
    root = base
    if rows:
        counts = rows.table.groupBy(rows.key.cast("string").alias("doc_id")).agg(F.count("*").alias("rows_"))
        root = base.join(counts, "doc_id", "left").withColumn("rows_", F.coalesce("rows_", F.lit(0)))
    else:
        root = base.withColumn("rows_", F.lit(0))
    n = F.col("rows_")
    parts = [_node(root, name, "CONT", None, F.lit(0), None, F.lit(0), [name], n * m + k, n + k)]
    leaf = F.lit(-1)
    for i, f in enumerate(fields):
        parts.append(_node(base, f.name, f.type, f.value, F.lit(i + 1), F.lit(0), F.lit(i), [name, f.name], F.lit(i + 1), leaf))
    if rows:
        own = rows.table.select("*", rows.key.cast("string").alias("doc_id"))
        own = own.withColumn("at_", F.row_number().over(Window.partitionBy("doc_id").orderBy(*rows.order)) - 1)
        first = F.col("at_").cast("long") * m + (k + 1)
        parts.append(_node(own, rows.name, "CONT", None, first, F.lit(0), F.col("at_") + k, [name, rows.name], first + (m - 1), F.lit(m - 1)))
        for i, f in enumerate(rows.fields):
            parts.append(_node(own, f.name, f.type, f.value, first + (i + 1), first, F.lit(i), [name, rows.name, f.name], first + (i + 1), leaf))
    return reduce(DataFrame.unionAll, parts)


def kinds_of(name: str, fields: list[Field], rows: Rows | None = None) -> dict[str, set[str]]:
    """The kinds of value of every name in such a tree."""
    out: dict[str, set[str]] = {name: {"s"}}
    if rows:
        out.setdefault(rows.name, set()).add("s")
    for f in [*fields, *(rows.fields if rows else [])]:
        out.setdefault(f.name, set()).add(TYPES[f.type].kind)
    return out
