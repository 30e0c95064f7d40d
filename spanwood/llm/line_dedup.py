"""Operator 8: line dedup. Two Bloom filters, for once-seen and twice-seen hashes, find suspected repeats.

Every block of documents sends the hashes of its line keys (each once) to shards of the hash space. A shard puts
them into a filter of once-seen hashes; those that were in it already, or that two documents of one block hold,
go into a filter of twice-seen ones. A key whose hash is in the second filter is suspected (a Bloom filter has no
false negatives, so every repeat is). Only suspected keys are then sent for confirmation: with a 128-bit digest
of the whole key and the smallest id of a block that holds it; the smallest id of all keeps its lines.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased. Keys of at least
`least` code points that at least two documents hold lose all their lines but in the smallest id that holds them.

Defined cases: a null or empty text is one empty line; a row with a null id stays as it is and counts for nothing;
rows that share an id count as one document; repeated lines within one document stay; columns beside id and text
are kept, whatever their names; an empty table gives an empty one.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import Block, ask, bits_of, blocks, rows_of, sent, with_answers
from .words import WEIGHT_LOWER, buffers, hash_spans, mix, spans

U = np.uint64
LEAST = 10
BITS_A_KEY, PROBES = 12, 4


class Bloom:
    """A filter of 64-bit hashes; its size follows the number that it is made for."""

    def __init__(self, n: int):
        self.size = U(max(64, BITS_A_KEY * n))
        self.bits = np.zeros(int(self.size), bool)

    def _at(self, h: np.ndarray):
        step = mix(h) | U(1)
        for i in range(PROBES):
            yield (h + U(i) * step) % self.size

    def add(self, h: np.ndarray) -> None:
        for at in self._at(h):
            self.bits[at] = True

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self._at(h):
            out &= self.bits[at]
        return out


class Lines:
    """Lines of a block's texts: where they are, their documents and their keys."""

    def __init__(self, texts: pa.Array, least: int):
        self.buf, offsets = buffers(texts)
        breaks = np.flatnonzero(self.buf == 10)
        self.start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        self.doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(breaks, offsets)) + 1)
        # an empty text's line begins where the next text does, so the documents of equal starts are put right by count
        self.end = np.empty_like(self.start)
        last = np.ones(len(self.start), bool)
        last[:-1] = self.doc[1:] != self.doc[:-1]
        self.end[~last] = self.start[1:][~last[:-1]] - 1
        self.end[last] = offsets[1:]
        word_start, word_end = spans(self.buf, offsets)
        first, after = np.searchsorted(word_start, self.start), np.searchsorted(word_end, self.end, "right")
        some = first < after
        self.key_start, self.key_end = self.start.copy(), self.start.copy()
        self.key_start[some] = word_start[first[some]]
        self.key_end[some] = word_end[after[some] - 1]
        points = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum((self.buf & 0xC0) != 0x80, out=points[1:])
        self.keyed = points[self.key_end] - points[self.key_start] >= least
        self.hash = hash_spans(self.buf, self.key_start, self.key_end, WEIGHT_LOWER)

    def digest(self, line: int) -> bytes:
        return hashlib.blake2b(self.buf[self.key_start[line] : self.key_end[line]].tobytes().lower(), digest_size=16).digest()


def _keys(lines: Lines, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines with a key in documents with an id: the lines, the distinct hashes, and each line's place among those."""
    own = np.flatnonzero(lines.keyed & block.known[lines.doc])
    hashes, place = np.unique(lines.hash[own], return_inverse=True)
    return own, hashes, place


def _first_last(ids: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, place, ids)
    np.maximum.at(high, place, ids)
    return low, high


def _suspects(lines: Lines, block: Block, n_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the suspected lines: the lines, the distinct digests (n, 2), and each line's place among those."""
    own, hashes, place = _keys(lines, block)
    yes = bits_of(block.told["told_once"], (hashes >> U(32)) % U(n_shards), n_shards)
    own = own[yes[place]]
    digests = np.frombuffer(b"".join(lines.digest(i) for i in own), "V16")
    distinct, place = np.unique(digests, return_inverse=True) if len(digests) else (digests, np.zeros(0, np.int64))
    return own, np.frombuffer(distinct.tobytes(), np.uint64).reshape(-1, 2), place


def drop_repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """df with the kept text in place of `text`, and the columns n_lines and n_dropped (before any of those names in df)."""
    carry = [c for c in df.columns if c not in (text, "n_lines", "n_dropped")]
    table, n = blocks(df, key, text, carry)

    def send_hashes(block: Block):
        lines = Lines(block.texts, least)
        own, hashes, place = _keys(lines, block)
        low, high = _first_last(block.ids[lines.doc[own]], place, len(hashes))
        yield from sent(block.number, (hashes >> U(32)) % U(n), n, hashes, (low != high).astype(np.uint8))

    def suspected(hashes, twice_here):
        once, twice = Bloom(len(hashes)), Bloom(len(hashes) // 2 + 1)
        step = 1 << 16
        for i in range(0, len(hashes), step):  # equal hashes in one slice are found by sorting it
            own, inverse, count = np.unique(hashes[i : i + step], return_inverse=True, return_counts=True)
            again = once.has(own) | (count > 1)
            again[inverse[twice_here[i : i + step] > 0]] = True
            twice.add(own[again])
            once.add(own)
        return twice.has(hashes)

    told = ask(table, send_hashes, suspected, ["u8", "u1"], n)
    once = with_answers(table, once=told)

    def send_suspects(block: Block):
        lines = Lines(block.texts, least)
        own, digests, place = _suspects(lines, block, n)
        low, _ = _first_last(block.ids[lines.doc[own]], place, len(digests))
        yield from sent(block.number, digests[:, 0] % U(n), n, digests[:, 0].copy(), digests[:, 1].copy(), low)

    def held_before(a, b, low):
        order = np.lexsort((low, b, a))
        a, b, low = a[order], b[order], low[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        out = np.zeros(len(a), bool)
        out[order] = low > low[new][np.cumsum(new) - 1]
        return out

    earlier = ask(once, send_suspects, held_before, ["u8", "u8", "i8"], n)

    def rebuild(batches):
        for block in rows_of(batches):
            lines = Lines(block.texts, least)
            own, digests, place = _suspects(lines, block, n)
            elsewhere = bits_of(block.told["told_earlier"], digests[:, 0] % U(n), n)
            low, _ = _first_last(block.ids[lines.doc[own]], place, len(digests))
            gone = np.zeros(len(lines.start), bool)
            gone[own] = elsewhere[place] | (block.ids[lines.doc[own]] > low[place])
            total = np.bincount(lines.doc, minlength=len(block.texts))
            dropped = np.bincount(lines.doc[gone], minlength=len(block.texts))
            texts = block.texts.to_pylist()
            for doc in np.flatnonzero(dropped):
                rows = np.flatnonzero(lines.doc == doc) if len(texts) < 8 else slice(*np.searchsorted(lines.doc, [doc, doc + 1]))
                texts[doc] = b"\n".join(lines.buf[s:e].tobytes() for s, e, g in zip(lines.start[rows], lines.end[rows], gone[rows]) if not g).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), block.rest], ["text", "n_lines", "n_dropped", "rest"])

    kind = table.schema["rest"].dataType.elementType.simpleString()
    out = with_answers(table, once=told, earlier=earlier).mapInArrow(rebuild, f"text string, n_lines long, n_dropped long, rest {kind}")
    kept = {c: F.col(f"rest.k{i}").alias(c) for i, c in enumerate(carry)} | {text: F.col("text").alias(text)}
    return out.select(*(kept[c] for c in df.columns if c in kept), "n_lines", "n_dropped")
