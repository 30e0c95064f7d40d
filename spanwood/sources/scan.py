"""Documents of one plain tree each, scanned many at a time as arrays of bytes, and the records that they hold.

Plain is what the writers give: canonical lines without escapes, or sound binary. Whatever else there is (comments, hex
names, escapes, rarer types, damage) is left to the readers that build trees, document by document, with the same result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import TYPES, raw_of
from .files import flattened

BATCH_BYTES = 1 << 21  # of documents that are scanned together
FEW = 8  # documents that aren't scanned but read one by one, if one of them isn't plain
DEEPEST = 64
LONGEST = 1 << 16  # bytes of a binary document that is walked along with others
XML_HEAD = b'<?xml version="1.0" encoding="UTF-8"?>\n<containerxml version="1">\n'
XML_TAIL = b"</containerxml>\n"
_ATOM, _ATOM_END = b'<atom name="????" type="????" value="', b'"></atom>'
_OPEN, _CLOSE = b'<container name="????">', b"</container>"
_NUMBER = {"unsigned": "u", "signed": "i", "float": "f"}
_u32 = lambda code: int.from_bytes(code.encode("latin-1"), "big")
_CODES = {_u32(t.code): t for t in TYPES.values() if t.family in (*_NUMBER, "c string", "container")}
_CONT = _u32("CONT")
_DIGITS = np.full(256, 255, np.uint8)
for _k, _c in enumerate(b"0123456789abcdef"):
    _DIGITS[_c] = _DIGITS[ord(chr(_c).upper())] = _k


class Unplain(Exception):
    """Some of the documents must be read one by one."""


def _want(ok) -> None:
    if not ok:
        raise Unplain


def _bytes_at(b: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    _want(not len(at) or at.max() + width <= len(b))
    return b[at[:, None] + np.arange(width)]


def _word(rows: np.ndarray) -> np.ndarray:
    """Four columns of bytes as one number."""
    return np.ascontiguousarray(rows).view(">u4")[:, 0].astype(np.int64)


def _is(rows: np.ndarray, pattern: bytes) -> bool:
    """Whether all rows are the pattern, but where it has ?."""
    fixed = np.frombuffer(pattern, np.uint8)
    at = np.flatnonzero(fixed != ord("?")) if b"????" in pattern else slice(None)
    return bool((rows[:, at] == fixed[at]).all())


class Nodes:
    """All nodes of some documents in their order: document, parent's row, depth, name, and values by kind."""

    def __init__(self, doc, depth, name, type_, is_open):
        self.doc, self.depth, self.name, self.type, self.is_open = doc, depth, name, type_, is_open
        n = len(doc)
        self.parent = np.full(n, -1, np.int64)
        _want(depth.max(initial=0) <= DEEPEST)
        for level in range(int(depth.max(initial=0))):
            above = np.maximum.accumulate(np.where(is_open & (depth == level), np.arange(n), -1))
            own = np.flatnonzero(depth == level + 1)
            self.parent[own] = above[own]
        self.values = {"i": np.zeros(n, np.int64), "f": np.zeros(n)}
        self.known = {k: np.zeros(n, bool) for k in self.values}

    def by_type(self) -> Iterator[tuple]:
        """Each type that is there, and its nodes' rows."""
        for code in np.unique(self.type).tolist():
            _want(code in _CODES)
            if code != _CONT:
                yield _CODES[code], np.flatnonzero(self.type == code)

    def put(self, kind: str, rows, values) -> None:
        if kind in self.values:
            self.values[kind][rows], self.known[kind][rows] = values, True


# ---- text and XML: lines


def _lines(b: np.ndarray, offsets: np.ndarray) -> tuple:
    """Starts, ends and first bytes behind tabs of all lines, and how many lines each document has."""
    _want((np.diff(offsets) > 0).all() and (b[offsets[1:] - 1] == 10).all())
    ends = np.flatnonzero(b == 10)
    starts = np.append(0, ends[:-1] + 1)
    at = starts.copy()
    for _ in range(DEEPEST + 2):
        tab = b[at] == 9
        if not tab.any():
            break
        at += tab
    else:
        raise Unplain
    counts = np.diff(np.append(0, np.searchsorted(ends, offsets[1:] - 1) + 1))
    return starts, ends, at, counts


def _nested(opens: np.ndarray, closes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Depth of each line that isn't a container's end; each document must be one whole container."""
    change = opens.astype(np.int64) - closes
    after = np.cumsum(change)
    last = np.cumsum(counts) - 1
    _want((after[last] == 0).all() and (after == 0).sum() == len(counts) and after.min() >= 0)
    return (after - change)[~closes]


def _numbers(b: np.ndarray, t, at: np.ndarray, to: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Values of number texts; forms that Arrow reads otherwise than the codec are not plain."""
    _want((to > at).all())
    minus = b[at] == 45
    first, size = b[np.minimum(at + minus, to - 1)], to - at - minus
    _want(((first >= 48) & (first <= 57) & (b[to - 1] >= 48) & (b[to - 1] <= 57)).all())
    if t.family == "float":
        values = texts.cast(pa.float64()).to_numpy(zero_copy_only=False)
        if t.width == 4:
            _want((np.abs(values) < np.finfo(np.float32).max).all())
            values = values.astype(np.float32).astype(np.float64)
        _want(np.isfinite(values).all())
        return values
    _want(((first != 48) | (size == 1)).all())
    values = texts.cast(pa.uint64() if t.family == "unsigned" else pa.int64()).to_numpy(zero_copy_only=False)
    if t.width < 8:
        low, high = (0, 1 << 8 * t.width) if t.family == "unsigned" else (-(1 << 8 * t.width - 1), 1 << 8 * t.width - 1)
        _want(((values >= low) & (values < high)).all())
    return values


def _valued(nodes: Nodes, b: np.ndarray, at: np.ndarray, to: np.ndarray, quoted: bool) -> int:
    """Reads the values that stand as text from at to to. The number of strings."""
    around = np.empty(2 * len(at), np.int32)
    around[::2], around[1::2] = at, to
    slices = pa.Array.from_buffers(pa.binary(), len(around) - 1, [None, pa.py_buffer(around), pa.py_buffer(b)])
    strings = 0
    for t, rows in nodes.by_type():
        if t.family in _NUMBER:
            texts = slices.take(pa.array(2 * rows)).cast(pa.string())
            nodes.put(t.kind, rows, _numbers(b, t, at[rows], to[rows], texts))
        else:
            strings += len(rows)
            if quoted:
                _want(((to - at)[rows] >= 2).all() and (b[at[rows]] == 34).all() and (b[to[rows] - 1] == 34).all())
    return strings


def _named(head: np.ndarray) -> np.ndarray:
    _want(((head > 0x20) & (head < 0x7F)).all())
    return _word(head)


def scan_text(b: np.ndarray, offsets: np.ndarray) -> Nodes:
    seen = np.bincount(b, minlength=256)
    starts, ends, at, counts = _lines(b, offsets)
    size = ends - at
    _want((size >= 3).all() and not np.isin(b[ends - 1], (9, 13, 32)).any())
    _want(seen[9] == (at - starts).sum() and seen[:32].sum() == seen[9] + seen[10] and not seen[127] and not seen[92])
    closes = size == 3
    _want(_is(_bytes_at(b, at[closes], 3), b"END"))
    own, to = at[~closes], ends[~closes]
    _want((to - own >= 10).all())
    head = _bytes_at(b, own, 10)
    _want((head[:, 0] != ord("#")).all() and (head[:, 4] == 58).all() and (head[:, 9] == 58).all())
    type_ = _word(head[:, 5:9])
    opens = np.zeros(len(at), bool)
    opens[~closes] = type_ == _CONT
    _want((size[opens] == 10).all())
    depth = _nested(opens, closes, counts)
    doc = np.repeat(np.arange(len(counts)), counts)[~closes]
    nodes = Nodes(doc, depth, _named(head[:, :4]), type_, type_ == _CONT)
    strings = _valued(nodes, b, own + 10, to, True)
    _want(seen[34] == 2 * strings)
    if seen[128:].any():
        pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(b)]).cast(pa.string())  # an error if it isn't UTF-8
    return nodes


def scan_xml(b: np.ndarray, offsets: np.ndarray) -> Nodes:
    n, seen = len(offsets) - 1, np.bincount(b, minlength=256)
    starts, ends, at, counts = _lines(b, offsets)
    _want((np.diff(offsets) > len(XML_HEAD) + len(XML_TAIL)).all() and (counts > 4).all())
    _want(_is(_bytes_at(b, offsets[:-1], len(XML_HEAD)), XML_HEAD) and _is(_bytes_at(b, offsets[1:] - len(XML_TAIL), len(XML_TAIL)), XML_TAIL))
    _want(seen[9] == (at - starts).sum() and seen[:32].sum() == seen[9] + seen[10] and not seen[128:].any() and not seen[ord("&")])
    first = np.cumsum(counts) - counts
    within = np.ones(len(at), bool)
    within[first] = within[first + 1] = within[first + counts - 1] = False
    at, ends, counts = at[within], ends[within], counts - 3
    size, kind = ends - at, b[at + 1]
    closes, opens, atoms = kind == ord("/"), kind == ord("c"), kind == ord("a")
    _want((closes | opens | atoms).all() and (size[closes] == len(_CLOSE)).all() and (size[opens] == len(_OPEN)).all() and (size[atoms] >= len(_ATOM) + len(_ATOM_END)).all())
    head, ahead = _bytes_at(b, at[atoms], len(_ATOM)), _bytes_at(b, at[opens], len(_OPEN))
    _want(_is(_bytes_at(b, at[closes], len(_CLOSE)), _CLOSE) and _is(ahead, _OPEN) and _is(head, _ATOM) and _is(_bytes_at(b, ends[atoms] - len(_ATOM_END), len(_ATOM_END)), _ATOM_END))
    n_open, n_close, n_atom = opens.sum(), closes.sum(), atoms.sum()
    for c, each, pairs in (("<", 3, 2), (">", 3, 2), ('"', XML_HEAD.count(b'"'), 6)):
        _want(seen[ord(c)] == n * each + n_atom * pairs + (2 * n_open if c == '"' else n_open + n_close))
    depth = _nested(opens, closes, counts)
    name, type_ = np.empty(len(at), np.int64), np.full(len(at), _CONT)
    name[opens], name[atoms], type_[atoms] = _named(ahead[:, 17:21]), _named(head[:, 12:16]), _word(head[:, 24:28])
    _want((type_[atoms] != _CONT).all())
    own = ~closes
    nodes = Nodes(np.repeat(np.arange(n), counts)[own], depth, name[own], type_[own], opens[own])
    begin, to = at + len(_ATOM), ends - len(_ATOM_END)
    begin[opens] = to[opens] = at[opens]
    _valued(nodes, b, begin[own], to[own], False)
    return nodes


# ---- binary


def scan_binary(b: np.ndarray, offsets: np.ndarray) -> Nodes:
    """All documents are walked side by side, a node of each at a time."""
    n = len(offsets) - 1
    _want((np.diff(offsets) <= LONGEST).all())
    at, level, live = offsets[:-1].copy(), np.zeros(n, np.int64), np.arange(n)
    ends = np.empty((n, DEEPEST + 2), np.int64)  # of what is open, the document first
    ends[:, 0] = offsets[1:]
    found = []
    while len(live):
        here, depth = at[live], level[live]
        head = _bytes_at(b, here, 12)
        size, type_ = _word(head[:, :4]), _word(head[:, 8:])
        end = here + size
        _want((size >= 12).all() and (end <= ends[live, depth]).all())
        found.append((live, depth, here, end, _word(head[:, 4:8]), type_))
        opens = type_ == _CONT
        at[live] = np.where(opens, here + 12, end)
        into = live[opens]
        level[into] += 1
        _want(level.max() <= DEEPEST)
        ends[into, level[into]] = end[opens]
        done = live
        while len(done):  # leaves what ends here
            done = done[(level[done] > 0) & (ends[done, level[done]] <= at[done])]
            level[done] -= 1
        live = live[at[live] < offsets[live + 1]]
    doc, depth, here, end, name, type_ = map(np.concatenate, zip(*found))
    order = np.argsort(here, kind="stable")
    doc, depth, here, end, name, type_ = (x[order] for x in (doc, depth, here, end, name, type_))
    _want((depth == 0).sum() == n)
    nodes = Nodes(doc, depth, name, type_, type_ == _CONT)
    zeros = None
    for t, rows in nodes.by_type():
        begin, to = here[rows] + 12, end[rows]
        if t.family in _NUMBER:
            _want((to - begin >= t.width).all())
            nodes.put(t.kind, rows, np.ascontiguousarray(_bytes_at(b, begin, t.width)).view(f">{_NUMBER[t.family]}{t.width}")[:, 0])
        else:  # one null byte, the last
            zeros = np.append(0, np.cumsum(b == 0)) if zeros is None else zeros
            _want((to > begin).all() and (b[to - 1] == 0).all() and (zeros[to] - zeros[begin] == 1).all())
    return nodes


def scan_hex(b: np.ndarray, offsets: np.ndarray) -> Nodes:
    _want((np.diff(offsets) >= 4).all() and not (offsets % 2).any() and (b[offsets[:-1]] == ord("0")).all() and np.isin(b[offsets[:-1] + 1], (ord("x"), ord("X"))).all())
    digits = _DIGITS[b]
    keep = np.ones(len(b) // 2, bool)
    keep[offsets[:-1] // 2] = False
    high, low = digits[::2][keep], digits[1::2][keep]
    _want((high < 16).all() and (low < 16).all())
    return scan_binary(high << 4 | low, offsets // 2 - np.arange(len(offsets)))


SCANNERS = {"text": scan_text, "xml": scan_xml, "binary": scan_binary, "hex": scan_hex}

# ---- records


def _read(key: str, data: bytes, form: str) -> Nodes:
    """One document by the reader that builds trees."""
    rows = flattened([(key, data)], form, True, False)
    column = lambda name: rows.column(rows.schema.get_field_index(name))
    nodes = Nodes(np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), column("name_u32").to_numpy(), None, None)
    nodes.is_open = np.asarray(pc.equal(column("type"), "CONT"))
    nodes.depth, nodes.parent = column("depth").to_numpy(), column("parent_id").fill_null(-1).to_numpy()
    for kind in nodes.values:
        known = np.asarray(column(kind).is_valid())
        nodes.put(kind, known, column(kind).drop_null().to_numpy())
    return nodes


def _records(nodes: Nodes, path: list[str], fields: dict[str, tuple[str, str]]) -> tuple[np.ndarray, list[pa.Array]]:
    """The document of each container that path leads to, and the greatest value that it has of each field."""
    number = lambda name: int.from_bytes(raw_of(name), "big")
    names = {column: number(name) for column, (name, _) in fields.items()}
    holders = np.flatnonzero((nodes.depth == len(path) - 1) & nodes.is_open)
    above, fits = holders, np.ones(len(holders), bool)
    for name in reversed(path):
        fits &= nodes.name[above] == number(name)
        above = nodes.parent[above]
    holders = holders[fits]
    rows = np.flatnonzero((nodes.depth == len(path)) & np.isin(nodes.name, list(names.values())))
    holds = np.zeros(len(nodes.depth), bool)
    holds[holders] = True
    rows = rows[holds[nodes.parent[rows]]]
    out = []
    for column, (_, kind) in fields.items():
        own = rows[(nodes.name[rows] == names[column]) & nodes.known[kind][rows]]
        at, values = np.searchsorted(holders, nodes.parent[own]), nodes.values[kind][own]
        most, known = np.full(len(holders), np.iinfo(np.int64).min if kind == "i" else -np.inf, values.dtype), np.zeros(len(holders), bool)
        np.maximum.at(most, at, values)
        known[at] = True
        out.append(pa.array(most, mask=~known))
    return nodes.doc[holders], out


def read_records(df: DataFrame, doc_id: str, content: str, form: str, path: list[str], fields: dict[str, tuple[str, str]]) -> DataFrame:
    """A row for each container that a path of names leads to: doc_id, and of its children the value of each field.

    A field is a column with a node's name and a kind (i or f); of several such nodes the greatest counts, and where there
    is none it is null. Documents are read whole, each must be one tree, and none is dropped.
    """
    types = {"i": pa.int64(), "f": pa.float64()}
    schema = pa.schema([("doc_id", pa.string()), *((column, types[kind]) for column, (_, kind) in fields.items())])
    shown = "doc_id string, " + ", ".join(f"{c} {'bigint' if kind == 'i' else 'double'}" for c, (_, kind) in fields.items())

    def tried(keys: pa.Array, data: pa.Array, offsets: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(keys)
        try:
            _want(not data.null_count and n > 0)
            nodes = SCANNERS[form](b[offsets[0] : offsets[-1]], offsets - offsets[0])
        except (Unplain, pa.ArrowInvalid):
            if n > FEW:
                half = n // 2
                yield from tried(keys[:half], data[:half], offsets[: half + 1], b)
                yield from tried(keys[half:], data[half:], offsets[half:], b)
            else:
                for k in range(n):
                    doc, columns = _records(_read(keys[k].as_py(), data[k].as_py() or b"", form), path, fields)
                    yield pa.RecordBatch.from_arrays([pa.array([keys[k].as_py()] * len(doc), pa.string()), *columns], schema=schema)
            return
        doc, columns = _records(nodes, path, fields)
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), *columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data = batch.column(0).cast(pa.string()), batch.column(1).cast(pa.binary())
            _, ends, content = data.buffers()
            offsets = np.frombuffer(ends, np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64) if len(data) else np.zeros(1, np.int64)
            b = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
            begin = 0
            while begin < len(data):
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BATCH_BYTES, "right")) - 1)
                yield from tried(keys[begin:end], data[begin:end], offsets[begin : end + 1], b)
                begin = end

    return df.select(F.col(doc_id).cast("string"), F.col(content).cast("binary")).mapInArrow(run, shown)
