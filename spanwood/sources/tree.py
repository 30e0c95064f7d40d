"""Trees in memory, as readers make them, and their rows of the flattened table."""

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from ..functions import codec
from ..types import NODES, TYPES, name_of, raw_of


class Node(NamedTuple):
    raw: bytes
    type: str
    data: bytes
    children: list | None


def make(name: str, code: str, value=None, children: list[Node] | None = None) -> Node:
    """A node of a host value (None: the type's zero), or a container of children."""
    if code == "CONT":
        return Node(raw_of(name), code, b"", list(children or []))
    if children is not None:
        raise ValueError(f"type {code} can't have children")
    return Node(raw_of(name), code, codec.encode_value(code, value), None)


class Flat:
    """Trees' rows of the flattened table, root first, gathered column by column and decoded type by type."""

    def __init__(self):
        self.docs: list[tuple[str, int, int]] = []  # id, ordinal and first row of each tree
        self.paths: dict[tuple[int, bytes], int] = {}  # a path is the path above and a name
        self.path: list[int] = []
        self.parent: list[int] = []
        self.place: list[int] = []
        self.count: list[int] = []
        self.type: list[str] = []
        self.data: list[bytes] = []

    def __len__(self) -> int:
        return len(self.data)

    def add(self, root: Node, doc_id: str, ordinal: int) -> None:
        self.docs.append((doc_id, ordinal, len(self.data)))
        paths, number = self.paths, 0
        todo = [(root, -1, 0, -1)]
        while todo:
            node, parent, place, above = todo.pop()
            path = paths.setdefault((above, node.raw), len(paths))
            self.path.append(path)
            self.parent.append(parent)
            self.place.append(place)
            self.type.append(node.type)
            self.data.append(node.data)
            children = node.children
            self.count.append(-1 if children is None else len(children))
            if children:
                todo.extend((children[i], number, i, path) for i in range(len(children) - 1, -1, -1))
            number += 1

    def batch(self) -> pa.RecordBatch:
        """All rows, with the columns of `types.NODES`. Data that its type doesn't allow is a ValueError."""
        n = len(self.data)
        full: list[list[str]] = []
        for above, raw in self.paths:
            full.append([*(full[above] if above >= 0 else ()), name_of(raw)])
        raws = np.array([int.from_bytes(raw, "big") for _, raw in self.paths], np.int64)
        path = np.array(self.path, np.int64)
        depth = np.array([len(x) - 1 for x in full], np.int32)[path] if n else np.zeros(0, np.int32)
        first = np.array([at for _, _, at in self.docs], np.int64)
        doc = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        number, parent = np.arange(n) - first[doc], np.array(self.parent, np.int64)
        size = np.ones(n, np.int64)
        for level in range(int(depth.max(initial=0)), 0, -1):
            own = np.flatnonzero(depth == level)
            np.add.at(size, parent[own] + first[doc[own]], size[own])
        names, types = pa.array([x[-1] for x in full], pa.string()), sorted(set(self.type))
        type_ = np.searchsorted(np.array(types), np.array(self.type)) if n else np.zeros(0, np.int64)
        shown = np.empty(n, object)
        u, u_known = np.zeros((n, 2), np.uint64), np.zeros(n, bool)
        i, i_known = np.zeros(n, np.int64), np.zeros(n, bool)
        f, f_known = np.zeros(n), np.zeros(n, bool)
        s = np.full(n, None, object)
        for k, code in enumerate(types):
            own = np.flatnonzero(type_ == k)
            values, shown[own] = codec.decode_all(code, [self.data[j] for j in own.tolist()])
            match TYPES[code].kind:
                case "u":
                    u[own, 0], u_known[own] = values, True
                case "i":
                    i[own], i_known[own] = values, True
                case "f":
                    f[own], f_known[own] = values, True
                case _:
                    s[own] = values
        ahead = [[f"{x[-1]}:{code}:" for x in full] for code in types]
        text = [ahead[k][p] + x for k, p, x in zip(type_.tolist(), self.path, shown.tolist())]
        take = lambda values, kind, at: pa.array(values, kind).take(pa.array(at, pa.int64()))
        bits = pa.py_buffer(np.packbits(u_known, bitorder="little").tobytes())
        columns = [
            take([d for d, _, _ in self.docs], pa.string(), doc),
            take([o for _, o, _ in self.docs], pa.int32(), doc),
            pa.array(number, pa.int64()),
            pa.array(parent, pa.int64(), mask=parent < 0),
            pa.array(self.place, pa.int32()),
            pa.array(depth, pa.int32()),
            pa.array(number + size - 1, pa.int64()),
            take(full, pa.list_(pa.string()), path),
            names.take(pa.array(path, pa.int64())),
            pa.array(raws[path] if n else raws, pa.int64()),
            take(types, pa.string(), type_),
            pa.array(self.count, pa.int32()),
            pa.array(self.data, pa.binary()),
            pa.Array.from_buffers(pa.decimal128(20, 0), n, [bits, pa.py_buffer(u.tobytes())]),
            pa.array(i, pa.int64(), mask=~i_known),
            pa.array(f, pa.float64(), mask=~f_known),
            pa.array(s, pa.string()),
            pa.array(text, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, NODES.fieldNames())
