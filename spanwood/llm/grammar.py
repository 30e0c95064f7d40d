"""Operator 6: token ids in binary shards, compressed by a Re-Pair grammar.

Documents are sorted by id and encoded; each about SHARD_IDS ids become a shard, whose frequent pairs of symbols are
replaced by nonterminals, again and again, the most frequent first. A round replaces up to RULES_A_ROUND pairs at
once (left to right where two overlap), until no pair is seen LEAST_COUNT times. A shard's file holds
its documents' ids and lengths, the rules, the rules' expansion lengths and the remaining symbols; with the lengths,
any range of ids is decoded from the symbols that cover it only. Files are rows of a table in the shared folder.

File format, all little-endian: ``RPG1``, five uint32 (documents, ids, rules, symbols, first nonterminal), document
ids int64, null marks uint8, document lengths uint32, rules uint32 pairs, rule lengths uint32, symbols' low uint16
halves, symbols' high uint8 parts.

Defined cases: a null or empty text is its end id only; documents with a null id come first; rows that share an id
are ordered by their text; an empty table gives no shards.
"""

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import ship, written
from .tokens import encoded

SHARD_IDS = 1 << 20
RULES_A_ROUND = 7000
LEAST_COUNT = 12
_TABLE_BITS = 20


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, rules (n, 2), first nonterminal)."""
    first = int(ids.max()) + 1 if len(ids) else 0
    seq, rules, top = ids.astype(np.uint32), [], first
    while len(seq) > 1:
        kind, half, odd = (np.uint32, 16, 0x9E3779B1) if top <= 1 << 16 else (np.uint64, 32, 0x9E3779B97F4A7C15)  # narrow keys sort faster
        keys = (seq[:-1].astype(kind, copy=False) << kind(half)) | seq[1:]
        ordered = np.sort(keys)
        new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(new, len(ordered)))
        often = np.flatnonzero(counts >= LEAST_COUNT)
        room = (1 << 24) - top  # symbols have 24 bits in the file
        if not len(often) or room <= 0:
            break
        often = often[np.argsort(-counts[often], kind="stable")[: min(RULES_A_ROUND, room)]]
        pairs = ordered[new[often]]
        # a table by hash finds the chosen pairs; of two that fall on one place the more frequent stays
        shift = kind(2 * half - _TABLE_BITS)
        table = np.full(1 << _TABLE_BITS, -1, np.int32)
        table[((pairs * kind(odd)) >> shift)[::-1]] = np.arange(len(pairs))[::-1]
        pairs_at = table[(keys * kind(odd)) >> shift]
        near = np.flatnonzero(pairs_at >= 0)
        hit = near[pairs[pairs_at[near]] == keys[near]]
        start = np.concatenate([[True], hit[1:] != hit[:-1] + 1])  # in a stretch of overlapping places every other one counts
        since = np.arange(len(hit)) - np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
        hit = hit[since % 2 == 0]
        chosen = pairs_at[hit]
        flag = np.zeros(len(pairs), bool)
        flag[chosen] = True
        used = pairs[flag].astype(np.int64)
        rules.append(np.column_stack([used >> half, used & ((1 << half) - 1)]))
        seq[hit] = top + (np.cumsum(flag) - 1)[chosen]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq, top = seq[keep], top + len(used)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), first


def _expand(symbols: np.ndarray, flat: np.ndarray, where: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids that symbols stand for, and how many each does."""
    inner = symbols >= first
    sizes, base = np.ones(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
    rule = symbols[inner] - first
    sizes[inner] = where[rule + 1] - where[rule]
    base[inner] = where[rule]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if inner.any():
        out = flat[np.repeat(base - (ends - sizes), sizes) + np.arange(total)]
    else:
        out = np.zeros(total, np.uint32)
    out[(ends - sizes)[~inner]] = symbols[~inner]
    return out, sizes


def expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """All nonterminals' expansions one after another (and a zero), and where each starts (n + 1 numbers)."""
    flat, where, at = np.zeros(1, np.uint32), np.zeros(1, np.int64), 0
    newest = rules.max(axis=1) - first if len(rules) else np.zeros(0, np.int64)
    while at < len(rules):  # as many rules at once as name earlier ones only: about a round's
        late = np.flatnonzero(newest[at:] >= at)
        end = at + int(late[0]) if len(late) else len(rules)
        out, sizes = _expand(rules[at:end].ravel(), flat, where, first)
        flat = np.concatenate([flat[:-1], out, np.zeros(1, np.uint32)])
        where = np.concatenate([where, where[-1] + np.cumsum(sizes.reshape(-1, 2).sum(axis=1))])
        at = end
    return flat, where


def pack(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    seq, rules, first = compress(ids)
    _, at = expansions(rules, first)
    head = struct.pack("<4s5I", b"RPG1", len(doc_ids), len(ids), len(rules), len(seq), first)
    return b"".join(
        [
            head,
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            np.array(lengths, "<u4").tobytes(),
            rules.astype("<u4").tobytes(),
            np.diff(at).astype("<u4").tobytes(),
            (seq & 0xFFFF).astype("<u2").tobytes(),
            (seq >> 16).astype(np.uint8).tobytes(),
        ]
    )


class Shard:
    """A shard's file, opened."""

    def __init__(self, data: bytes):
        magic, docs, self.n_ids, n_rules, n_symbols, self.first = struct.unpack_from("<4s5I", data)
        if magic != b"RPG1":
            raise ValueError("not a shard of token ids")
        self._at, self._data = 24, data
        ids, null = self._next("<i8", docs), self._next(np.uint8, docs)
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), null.tolist())]
        self.lengths = self._next("<u4", docs).astype(np.int64)
        rules = self._next("<u4", 2 * n_rules).reshape(-1, 2)
        self.rule_lengths = self._next("<u4", n_rules).astype(np.int64)
        self.symbols = self._next("<u2", n_symbols).astype(np.int64) | self._next(np.uint8, n_symbols).astype(np.int64) << 16
        self.flat, self.where = expansions(rules.astype(np.int64), self.first)
        if not np.array_equal(np.diff(self.where), self.rule_lengths):
            raise ValueError("a shard's rules and their lengths differ")
        sizes = np.ones(n_symbols, np.int64)
        inner = self.symbols >= self.first
        sizes[inner] = self.rule_lengths[self.symbols[inner] - self.first]
        self.ends = np.cumsum(sizes)

    def _next(self, kind, n: int) -> np.ndarray:
        out = np.frombuffer(self._data, kind, n, self._at)
        self._at += out.nbytes
        return out

    def decode(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop], from the symbols that cover them."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        low, high = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left") + 1
        before = int(self.ends[low - 1]) if low else 0
        out, _ = _expand(self.symbols[low:high], self.flat, self.where, self.first)
        return out[start - before : stop - before]


def encode_to_shards(df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The written table of shards (shard, part, n_ids, start, data); start: the ids of all shards before."""
    ship(df.sparkSession)
    plain = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        n, ids, lengths, held, size = part << 32, [], [], [], 0

        def close():
            data = pack(ids, lengths, np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([part], pa.int64()), pa.array([size // 4], pa.int64()), pa.array([data], pa.binary())], ["shard", "part", "n_ids", "data"])

        for b in batches:
            for doc, own in zip(b.column("id").to_pylist(), encoded(tokenizer, b.column("text"))):
                own += end
                if ids and size + len(own) > 4 * SHARD_IDS:
                    yield close()
                    n, ids, lengths, held, size = n + 1, [], [], [], 0
                ids.append(doc)
                lengths.append(len(own) // 4)
                held.append(own)
                size += len(own)
        if ids:
            yield close()

    sorted_ = plain.repartitionByRange("id").sortWithinPartitions("id", "text")
    files = written(sorted_.mapInArrow(shards, "shard long, part long, n_ids long, data binary"), "ids")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    own = Window.partitionBy("part").orderBy("shard")
    starts = files.select("shard", "part", (F.sum("n_ids").over(own) - F.col("n_ids")).alias("inside")).join(before, "part").select("shard", (F.col("base") + F.col("inside")).alias("start"))
    return files.join(starts, "shard")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's ids from the files; start: the ids of all documents before it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                shard, base = Shard(b.column("data")[r].as_py()), b.column("start")[r].as_py()
                ends = np.cumsum(shard.lengths)
                ids = shard.decode(0, shard.n_ids)
                at = ends - shard.lengths
                binary = [ids[s:e].astype("<u4").tobytes() for s, e in zip(at.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(base + at, pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(binary, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return shards.select("start", "data").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
