"""Documents of relational tables, written without a node table: the rows, sorted by document, become pieces of text or
bytes column by column in Arrow batches, and a document is the pieces of its rows. One shuffle of the rows, none without
child rows. The bodies are those that the sinks give for the node table.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec
from ..sources.tables import Field, Tree
from ..types import TYPES, raw_of

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;"))
_TEXT = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), *((chr(c), f"\\x{c:02X}") for c in (*range(10), 11, 12, *range(14, 32), 127)))


def _cast(table: DataFrame, f: Field) -> str | None:
    """The Spark type in which a field's values are written here; None if they aren't."""
    kind, family = table.select(f.value).schema[0].dataType, TYPES[f.type].family
    if family in ("unsigned", "signed") and isinstance(kind, _INTEGERS):
        return "bigint"
    if f.type == "FP64" and isinstance(kind, T.NumericType):
        return "double"
    return "string" if f.type == "CSTR" and isinstance(kind, T.StringType) else None


def _casts(tree: Tree) -> list[list[str | None]]:
    return [[_cast(tree.table, f) for f in tree.fields], [_cast(tree.rows.table, f) for f in tree.rows.fields] if tree.rows else []]


def writable(tree: Tree | None) -> bool:
    return tree is not None and None not in sum(_casts(tree), [])


# ---- values


def _float_texts(values: pa.Array) -> pa.Array:
    """All digits, distinct values once each."""
    each = values.view(pa.int64()).dictionary_encode()
    distinct = each.dictionary.view(pa.float64()).to_numpy()
    if not np.isfinite(distinct).all():
        codec.encode_value("FP64", float(distinct[~np.isfinite(distinct)][0]))  # says which
    shown = ("%.17E\n" * len(distinct) % tuple(distinct.tolist())).split("\n")[:-1]
    return pa.array(shown, pa.string()).take(each.indices)


def _finite_or_null(values: pa.Array) -> pa.Array:
    return pc.if_else(pc.is_nan(values), pa.scalar(None, pa.float64()), values)


def _replaced(values: pa.Array, pairs, odd: str) -> pa.Array:
    if pc.any(pc.match_substring_regex(values, odd)).as_py():
        for plain, named in pairs:
            values = pc.replace_substring(values, plain, named)
    return values


def _shown(f: Field, values: pa.Array, xml: bool) -> pa.Array:
    """A value as it stands in text or XML."""
    if f.type == "FP64":
        return _float_texts(_finite_or_null(values))
    if f.type != "CSTR":
        return values.cast(pa.string())
    if not xml:
        return _replaced(values, _TEXT, r'[\x00-\x1f"\\\x7f]')
    values = _replaced(values, _XML, "[&<>\"'\t\n\r]")
    return pc.replace_substring_regex(values, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "�")


def _bytes_of(rows: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Rows of a matrix as binary values."""
    n, width = rows.shape
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [mask, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(rows))])


def _header(name: str, code: str, sizes: np.ndarray) -> np.ndarray:
    out = np.empty((len(sizes), 12), np.uint8)
    out[:, :4] = sizes.astype(">u4").view(np.uint8).reshape(-1, 4)
    out[:, 4:] = np.frombuffer(raw_of(name) + code.encode("latin-1"), np.uint8)
    return out


def _sizes(values: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)


def _joined(parts: list) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "" if pa.types.is_string(parts[0].type) else b"", null_handling="skip")


def _binary_field(f: Field, values: pa.Array) -> list:
    """Matrices and binary values that make up the field's nodes."""
    if f.type == "CSTR":
        data = values.cast(pa.binary())
        return [_header(f.name, f.type, 13 + _sizes(data)), data, np.zeros((len(data), 1), np.uint8)]
    width = TYPES[f.type].width
    if f.type == "FP64":
        v = values.to_numpy(zero_copy_only=False)
        if np.isinf(v).any():
            codec.encode_value(f.type, float(v[np.isinf(v)][0]))
        data = v.astype(">f8")
    else:
        v = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
        if width < 8 and len(bad := v[(v < -(1 << 8 * width - 1)) | (v >= 1 << 8 * width)]):
            raise ValueError(f"value exceeds range of {8 * width} bits: {bad[0]}")
        data = v.astype(">i8")
    data = data.view(np.uint8).reshape(-1, 8)[:, 8 - width :]
    return [np.hstack([_header(f.name, f.type, np.full(len(v), 12 + width)), data])]


def _merged(parts: list) -> list[pa.Array]:
    """Binary columns, neighbouring matrices as one."""
    out, held = [], []
    for p in [*parts, None]:
        if isinstance(p, np.ndarray):
            held.append(p)
            continue
        if held:
            out.append(_bytes_of(np.hstack(held)))
            held = []
        if p is not None:
            out.append(p)
    return out


def _binary_rows(fields: list[Field], columns: list[pa.Array], n: int) -> pa.Array:
    """All fields' nodes of each row. A null has none."""
    parts: list = [np.zeros((n, 0), np.uint8)]
    for f, values in zip(fields, columns):
        if f.type == "FP64":
            values = _finite_or_null(values)
        own = _binary_field(f, values)
        if values.null_count:
            whole = _joined(_merged(own))
            own = [pc.if_else(values.is_valid(), whole, pa.scalar(None, pa.binary()))]
        parts += own
    return _joined(_merged(parts))


def _text_rows(fields: list[Field], columns: list[pa.Array], n: int, opened: str, depth: int, closed: str, xml: bool) -> pa.Array:
    """What opens and closes a row, and between them a line for each field that isn't null."""
    parts: list = []
    tail = opened
    for f, values in zip(fields, columns):
        quote = '"' if f.type == "CSTR" and not xml else ""
        before = f'<atom name="{_plain_xml(f.name)}" type="{f.type}" value="' if xml else f"{f.name}:{f.type}:{quote}"
        before, after = "\t" * depth + before, '"></atom>\n' if xml else quote + "\n"
        shown = _shown(f, values, xml)
        if shown.null_count:
            parts += [pa.scalar(tail), pc.binary_join_element_wise(before, shown, after, "")]
            tail = ""
        else:
            parts += [pa.scalar(tail + before), shown]
            tail = after
    whole = pc.binary_join_element_wise(*parts, tail + closed, "", null_handling="skip") if parts else pa.array([tail + closed] * n, pa.string())
    return whole


def _plain_xml(name: str) -> str:
    for plain, named in _XML:
        name = name.replace(plain, named)
    return name


# ---- documents


class _Writer:
    def __init__(self, tree: Tree, form: str, head: str):
        self.form, self.xml, self.head = form, form == "xml", head
        named = lambda fields: [Field(f.name, f.type, None) for f in fields]  # noqa: E731  columns aren't sent to workers
        self.name, self.fields = tree.name, named(tree.fields)
        self.row, self.row_fields = (tree.rows.name, named(tree.rows.fields)) if tree.rows else ("", [])
        self.text = form != "binary"
        self.kind = pa.string() if self.text else pa.binary()

    def opened(self, name: str, depth: int) -> str:
        return "\t" * depth + (f'<container name="{_plain_xml(name)}">\n' if self.xml else f"{name}:CONT:\n")

    def closed(self, depth: int) -> str:
        return "\t" * depth + ("</container>\n" if self.xml else "END\n")

    def pieces(self, batch: pa.RecordBatch, is_line: bool) -> pa.Array:
        """A piece of its document for each row."""
        n, k = len(batch), len(self.fields)
        fields, columns = (self.row_fields, batch.columns[2 + k :]) if is_line else (self.fields, batch.columns[2 : 2 + k])
        base = int(self.xml)
        if not self.text:
            body = _binary_rows(fields, columns, n)
            return _joined([_bytes_of(_header(self.row, "CONT", 12 + _sizes(body))), body]) if is_line else body
        if is_line:
            return _text_rows(fields, columns, n, self.opened(self.row, base + 1), base + 2, self.closed(base + 1), self.xml)
        return _text_rows(fields, columns, n, self.head + self.opened(self.name, base), base + 1, "", self.xml)

    def whole(self, inner: pa.Array) -> pa.Array:
        """Documents of what they hold."""
        if not self.text:
            return _joined([_bytes_of(_header(self.name, "CONT", 12 + _sizes(inner))), inner])
        return pc.binary_join_element_wise(inner, self.closed(int(self.xml)) + ("</containerxml>\n" if self.xml else ""), "")

    def documents(self, keys: pa.Array, line: np.ndarray, pieces: pa.Array) -> pa.RecordBatch:
        """Whole documents of rows in their order. Lines without a document's own row have none; a repeated one has the lines each time."""
        new = _changes(keys)
        starts = np.flatnonzero(new)
        tops = np.add.reduceat(~line, starts) if len(starts) else starts
        if (tops == 1).all():
            taken, offsets, first = pieces, np.append(starts, len(keys)), starts
        else:
            index, offsets, first = [], [0], []
            for start, end, n in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], tops.tolist()):
                for top in range(start, start + n):  # they come before the lines
                    index += [top, *range(start + n, end)]
                    offsets.append(len(index))
                    first.append(top)
            taken = pieces.take(pa.array(index, pa.int64()))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), taken)
        body = self.whole(pc.binary_join(lists, "" if self.text else b""))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(first, pa.int64())), pa.array(np.zeros(len(body), np.int32)), body], ["doc_id", "root_ord", "body"])

    def alone(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that are one row each."""
        for batch in batches:
            body = self.whole(self.pieces(batch, False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(len(body), np.int32)), body], ["doc_id", "root_ord", "body"])

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # parts of the document that may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            line = batch.column(1).to_numpy(zero_copy_only=False)
            top_rows, line_rows = np.flatnonzero(~line), np.flatnonzero(line)
            place = np.empty(len(line), np.int64)
            place[top_rows], place[line_rows] = np.arange(len(top_rows)), len(top_rows) + np.arange(len(line_rows))
            parts = [self.pieces(batch.take(pa.array(rows)), is_line) for rows, is_line in ((top_rows, False), (line_rows, True)) if len(rows)]
            pieces = pa.concat_arrays(parts).take(pa.array(place))
            keys = batch.column(0)
            last = int(np.flatnonzero(_changes(keys))[-1])
            if held and (last or held[0][0][0] != keys[0]):
                if last:
                    held.append((keys[:last], line[:last], pieces[:last]))
                yield self.documents(*_concat(held))
                held = []
            elif last:
                yield self.documents(keys[:last], line[:last], pieces[:last])
            held.append((keys[last:], line[last:], pieces[last:]))
        if held:
            yield self.documents(*_concat(held))


def _changes(keys: pa.Array) -> np.ndarray:
    """Where a document begins; rows without a key are one."""
    new = np.ones(len(keys), bool)
    if len(keys) > 1:
        a, b = keys[1:], keys[:-1]
        same = pc.or_kleene(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
        new[1:] = ~same.to_numpy(zero_copy_only=False)
    return new


def _concat(parts: list[tuple]) -> tuple:
    return pa.concat_arrays([k for k, _, _ in parts]), np.concatenate([x for _, x, _ in parts]), pa.concat_arrays([p for _, _, p in parts])


def _keyed(tree: Tree):
    """The column `key` of a key; a string, unless both tables have keys of one plain type."""
    kinds = {str(t.select(k).schema[0].dataType) for t, k in ((tree.table, tree.key), (tree.rows.table, tree.rows.key))}
    plain = len(kinds) == 1 and kinds <= {str(t()) for t in (*_INTEGERS, T.StringType)}
    return lambda k: (k if plain else k.cast("string")).alias("key")


def _row_length(table: DataFrame, fields: list[Field]) -> Column:
    """Bytes of a row's container in the binary form, with the checks that writing it makes."""
    out = F.lit(12).cast("long")
    for f in fields:
        v, width, error = f.value.cast(_cast(table, f)), TYPES[f.type].width, F.lit(True)
        if f.type == "FP64":
            v = F.nanvl(v, F.lit(None).cast("double"))
            error = F.abs(v) == float("inf")
        elif width is not None:
            error = ~v.between(-(1 << 8 * width - 1), min((1 << 8 * width) - 1, (1 << 63) - 1)) if width < 8 else F.lit(False)
        size = F.octet_length(v) + 13 if width is None else F.when(error, F.raise_error(F.concat(F.lit(f"value exceeds range of type {f.type}: "), v.cast("string"))).cast("int")).otherwise(12 + width)
        out = out + F.when(v.isNull(), 0).otherwise(size)
    return out


def lengths(tree: Tree) -> DataFrame:
    """(doc_id, root_ord, length) of whole documents: child rows' lengths are summed by document, and nothing is written."""
    own = _row_length(tree.table, tree.fields).alias("length")
    if not tree.rows:
        return tree.table.select(tree.key.cast("string").alias("doc_id"), F.lit(0).alias("root_ord"), own)
    rows, key = tree.rows, _keyed(tree)
    sums = rows.table.where(rows.key.isNotNull()).select(key(rows.key), _row_length(rows.table, rows.fields).alias("more")).groupBy("key").agg(F.sum("more").alias("more"))
    out = tree.table.select(key(tree.key), own).join(sums, "key", "left")
    return out.select(F.col("key").cast("string").alias("doc_id"), F.lit(0).alias("root_ord"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"))


def sorted_rows(tree: Tree) -> DataFrame:
    """(key, line, t0 ..., r0 ...): each document's own row, then its child rows in order, within one partition."""
    own: list[Column] = [f.value.alias(f"t{i}") for i, f in enumerate(tree.fields)]
    if not tree.rows:
        return tree.table.select(tree.key.alias("key"), F.lit(False).alias("line"), *own)
    rows, key = tree.rows, _keyed(tree)
    values = {str(f.value): f"r{i}" for i, f in enumerate(rows.fields)}
    order = [F.col(o) if isinstance(o, str) else o for o in rows.order]
    by = [values.get(str(o), f"o{i}") for i, o in enumerate(order)]
    more = [o.alias(name) for o, name in zip(order, by) if name.startswith("o")]
    top = tree.table.select(key(tree.key), F.lit(False).alias("line"), *own)
    lines = rows.table.where(rows.key.isNotNull()).select(key(rows.key), F.lit(True).alias("line"), *(f.value.alias(f"r{i}") for i, f in enumerate(rows.fields)), *more)
    return top.unionByName(lines, allowMissingColumns=True).repartition("key").sortWithinPartitions("key", "line", *by)


def written(tree: Tree, form: str, head: str = "") -> DataFrame:
    """(doc_id, root_ord, body) in the form binary, text or xml; `head` stands before each XML document."""
    top, line = _casts(tree)
    columns = [F.col(f"t{i}").cast(c) for i, c in enumerate(top)] + [F.col(f"r{i}").cast(c) for i, c in enumerate(line)]
    writer = _Writer(tree, form, head)
    rows = sorted_rows(tree).select(F.col("key").cast("string").alias("doc_id"), "line", *columns)
    return rows.mapInArrow(writer.run if tree.rows else writer.alone, f"doc_id string, root_ord int, body {'binary' if form == 'binary' else 'string'}")
