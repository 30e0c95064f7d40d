"""Operator 3: bounded-space online packing of token sequences.

Each partition keeps at most OPEN unfinished windows of SIZE ids. A document is cut into full windows and a rest;
the rest goes where it fits best (the least room that is enough). If it fits nowhere, a new window is opened, or, if
OPEN are, the fullest is emitted: its room, if LEAST_CUT or more, is filled with a cut from the rest. At the
partition's end its open windows are packed again, longest piece first, so that one unfinished window at most is
left. These are merged in two more rounds, first by groups of partitions (about the root of their number), then all.

Defined cases: a null or empty text is its end id only; documents with null ids or shared ids are packed each on its
own; no id is lost or doubled; an empty table gives no pieces.
"""

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship, written
from .tokens import encoded

SIZE = 2048
OPEN = 64
LEAST_CUT = 32

PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, open boolean, part long"


class Packer:
    """Pieces are (doc_id, start, doc_tokens, ids as bytes). done: (pieces) of each finished window."""

    def __init__(self, size: int = SIZE, most: int = OPEN, least_cut: int = LEAST_CUT):
        self.size, self.most, self.least_cut = size, most, least_cut
        self.rooms: list[tuple[int, int]] = []  # (room, window), sorted
        self.windows: dict[int, list] = {}
        self.count = 0
        self.done: list[list] = []

    def add(self, piece) -> None:
        doc, start, total, ids = piece
        full = 4 * self.size
        while len(ids) >= full:
            self.done.append([(doc, start, total, ids[:full])])
            start, ids = start + self.size, ids[full:]
        while ids:
            n = len(ids) // 4
            i = bisect.bisect_left(self.rooms, (n, -1))
            if i == len(self.rooms) and len(self.windows) >= self.most:
                room, w = self.rooms[0]
                if room >= self.least_cut:
                    self._place(0, (doc, start, total, ids[: 4 * room]))
                    start, ids = start + room, ids[4 * room :]
                else:
                    self.rooms.pop(0)
                    self.done.append(self.windows.pop(w))
                continue
            if i == len(self.rooms):
                self.count += 1
                self.windows[self.count] = []
                self.rooms.append((self.size, self.count))
            self._place(i, (doc, start, total, ids))
            return

    def _place(self, i: int, piece) -> None:
        room, w = self.rooms.pop(i)
        self.windows[w].append(piece)
        room -= len(piece[3]) // 4
        if room:
            bisect.insort(self.rooms, (room, w))
        else:
            self.done.append(self.windows.pop(w))

    def rest(self) -> list:
        """The pieces of all unfinished windows, which are closed."""
        out = [p for w in sorted(self.windows) for p in self.windows[w]]
        self.windows, self.rooms = {}, []
        return out


def merged(pieces: list, size: int = SIZE) -> tuple[list[list], list]:
    """Full windows of the pieces, longest first and cut where a window ends, and the pieces of the one that isn't full."""
    packer = Packer(size, 1, 1)
    for p in sorted(pieces, key=lambda p: -len(p[3])):
        packer.add(p)
    return packer.done, packer.rest()


def _batch(windows: list[list], first: int, open_: bool, part: int) -> pa.RecordBatch:
    rows = []
    for n, window in enumerate(windows):
        at = 0
        for doc, start, total, ids in window:
            rows.append((doc, start, len(ids) // 4, total, ids, first + n, at, open_, part))
            at += len(ids) // 4
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
    columns = list(zip(*rows)) or [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset", "open", "part"])


def pack_documents(df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset) of all pieces; ids: little-endian unsigned 32-bit."""
    ship(df.sparkSession)
    plain = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, n = Packer(), part << 32
        for b in batches:
            for doc, ids in zip(b.column("id").to_pylist(), encoded(tokenizer, b.column("text"))):
                ids += end
                packer.add((doc, 0, len(ids) // 4, ids))
                if len(packer.done) >= 256:
                    yield _batch(packer.done, n, False, part)
                    n += len(packer.done)
                    packer.done = []
        done, rest = merged(packer.rest())
        done = packer.done + done
        yield _batch(done, n, False, part)
        if rest:
            yield _batch([rest], n + len(done), True, part)

    pieces = written(plain.mapInArrow(pack, PIECE), "pieces")
    parts = pieces.agg(F.max("part")).first()[0]
    group = math.isqrt(parts or 0) + 1

    def merge(first: int, divisor: int, last: bool):
        def run(batches):
            held: dict[int, list] = {}
            for b in batches:
                for r in b.to_pylist():
                    held.setdefault(r["part"] // divisor, []).append(r)
            for g, rows in sorted(held.items()):
                rows.sort(key=lambda r: (r["part"], r["offset"]))
                done, rest = merged([(r["doc_id"], r["start"], r["doc_tokens"], r["ids"]) for r in rows])
                n = first + (g << 32)
                yield _batch(done + ([rest] if last and rest else []), n, False, g)
                if rest and not last:
                    yield _batch([rest], n + len(done), True, g)

        return run

    names = [c.split()[0] for c in PIECE.split(", ")]
    left = pieces.where("open").select(names)
    once = written(left.repartition(F.floor(F.col("part") / group)).mapInArrow(merge(1 << 60, group, False), PIECE), "merged")
    twice = once.where("open").select(names).repartition(1).mapInArrow(merge(1 << 61, 1 << 62, True), PIECE)
    out = pieces.where("NOT open").unionByName(once.where("NOT open")).unionByName(twice)
    return out.drop("open", "part")
