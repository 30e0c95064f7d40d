"""Operator 9: substring dedup by recompression.

Words are parsed by rounds that name runs of one symbol and then pairs of symbols (left and right classes come from
a bit of the name). A name is a fingerprint of what it names, so it is the same on every executor and in every
document without a table of names. Each symbol carries its context: the words that settle that it stands there.
Wherever those words occur, the same symbol does. A window of WINDOW words is filed under the first high-level
symbol whose context it contains, or, if there is none, under the next lower level, and in the end under itself;
this depends on the window's words alone, so equal windows are filed under equal symbols.

Two rounds over all blocks follow (see `exchange`): which symbols occur more than once, and, for windows filed
under those only, whether an equal window starts earlier. Windows are compared by 64-bit fingerprints of their words
and dealt by these, not by their symbols: one frequent symbol can have a hundredth of all windows, whatever the input.

A window is WINDOW consecutive words ``[^\\x20\\x09-\\x0D]+`` of one document. Words covered by a window that
also starts earlier (smaller id, or same document and earlier start) are removed; the others are joined by one space.

Defined cases: a null or empty text has no words; a row with a null id is only joined anew and counts for nothing;
rows that share an id count as one document's parts, each with its own windows, in the order that they are read;
columns beside id and text are kept, whatever their names; an empty table gives an empty one.
"""

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import Block, ask, bits_of, blocks, rows_of, sent, with_answers
from .words import _INV, _P, mix, powers, word_hashes

U = np.uint64
WINDOW = 20
ROUNDS = 4
LOWER_LEVEL = 2


class Symbols:
    """Symbols of one level over the words of a block; the context of each is words[low:high]."""

    def __init__(self, name, doc, low, high, begin, end):
        self.name, self.doc, self.low, self.high, self.begin, self.end = name, doc, low, high, begin, end

    def _neighbours(self):
        """The context that the symbol before and after each adds; beyond a document's edge it can't be met by any window."""
        same = self.doc[1:] == self.doc[:-1]
        before, after = self.begin[self.doc] - 1, self.end[self.doc] + 1
        before[1:][same] = self.low[:-1][same]
        after[:-1][same] = self.high[1:][same]
        return same, before, after

    def runs(self) -> "Symbols":
        """Each run of one name becomes one symbol, named by that name and the run's length."""
        if not len(self.name):
            return self
        same, before, after = self._neighbours()
        new = np.ones(len(self.name), bool)
        new[1:] = ~(same & (self.name[1:] == self.name[:-1]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new)) - 1
        count = (last - first + 1).astype(U)
        name = np.where(count > U(1), mix(self.name[first] + count * U(0xD6E8FEB86659FD93)), self.name[first])
        return Symbols(name, self.doc[first], before[first], after[last], self.begin, self.end)

    def pairs(self, salt: int) -> "Symbols":
        """Each symbol of the left class and its follower of the right class become one symbol."""
        if not len(self.name):
            return self
        same, before, after = self._neighbours()
        left = (mix(self.name ^ U(salt)) >> U(62)) < U(2)
        pair = np.zeros(len(self.name), bool)
        pair[:-1] = same & left[:-1] & ~left[1:]
        second = np.zeros(len(self.name), bool)
        second[1:] = pair[:-1]
        low, high = np.where(left, self.low, before), np.where(left, after, self.high)
        name = self.name.copy()
        at = np.flatnonzero(pair)
        name[at] = mix(self.name[at] * U(3) + mix(self.name[at + 1] + U(salt)))
        low[at], high[at] = self.low[at], self.high[at + 1]
        keep = ~second
        return Symbols(name[keep], self.doc[keep], low[keep], high[keep], self.begin, self.end)


def parse(words: np.ndarray, bounds: np.ndarray) -> list[Symbols]:
    """The levels' symbols; bounds: where each document's words start, and their end."""
    n = len(words)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = Symbols(words, doc, np.arange(n), np.arange(1, n + 1), bounds[:-1], bounds[1:]).runs()
    out = []
    for i in range(ROUNDS):
        at = at.pairs(0x9E3779B9 * (i + 1))
        out.append(at)
    return out


class Windows:
    """All windows of a block's texts, and the symbol that each is filed under."""

    def __init__(self, block: Block):
        order = np.argsort(block.ids, kind="stable")
        self.order, self.ids, self.known = order, block.ids[order], block.known[order]
        self.texts = block.texts.take(pa.array(order))
        words, self.bounds = word_hashes(self.texts)
        self.n_words = len(words)
        doc = np.repeat(np.arange(len(order)), np.diff(self.bounds))
        room = np.maximum(0, np.diff(self.bounds) - WINDOW + 1) * self.known
        self.start = np.flatnonzero(np.arange(self.n_words) - self.bounds[doc] < room[doc]) if self.n_words else np.zeros(0, np.int64)
        self.doc = doc[self.start]
        sums = np.zeros(self.n_words + 1, U)
        np.cumsum(words * powers(_P, self.n_words), out=sums[1:])
        self.hash = mix((sums[self.start + WINDOW] - sums[self.start]) * powers(_INV, self.n_words + 1)[self.start])
        self.filed = mix(self.hash ^ U(0xA5A5A5A5))
        self.at = np.arange(len(self.start))  # which symbol of which level; windows of one symbol stand side by side
        left = self.at.copy()
        levels = parse(words, self.bounds)
        for i, level in enumerate((levels[-1], levels[LOWER_LEVEL - 1])):
            if len(left) and len(level.name):
                k = np.searchsorted(level.low, self.start[left])
                k[k == len(level.low)] = len(level.low) - 1
                fits = (level.low[k] >= self.start[left]) & (level.high[k] <= self.start[left] + WINDOW)
                self.filed[left[fits]] = level.name[k[fits]]
                self.at[left[fits]] = k[fits] + (i + 1) * self.n_words
                left = left[~fits]
        self.unfiled = len(left)

    def names(self):
        """Distinct symbols, each window's place among them, and which occur at two places here."""
        names, place = np.unique(self.filed, return_inverse=True)
        new = np.ones(len(place), bool)
        new[1:] = self.at[1:] != self.at[:-1]
        return names, place, np.bincount(place[new], minlength=len(names)) > 1

    def distinct(self, chosen: np.ndarray):
        """Of the chosen windows: the first of each content, and for each its place among those."""
        own = np.flatnonzero(chosen)
        _, first, place = np.unique(self.hash[own], return_index=True, return_inverse=True)
        return own, own[first], place


def _shard(names: np.ndarray, n: int) -> np.ndarray:
    return (names >> U(34)) % U(n)


def _started_before(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows have an equal one of a smaller id, or of the same id and further up. Sorted by ranges of the hashes, so that no order of all is held."""
    out = np.zeros(len(hashes), bool)
    part = (hashes >> U(60)).astype(np.uint8)
    for i in range(16):
        own = np.flatnonzero(part == i)
        own = own[np.lexsort((ids[own], hashes[own]))]  # stable: of equal ids the lower block's comes first
        out[own[1:]] = hashes[own[1:]] == hashes[own[:-1]]
    return out


def drop_repeated_windows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the kept words in place of `text`, and the columns n_words and n_removed (before any of those names in df)."""
    carry = [c for c in df.columns if c not in (text, "n_words", "n_removed")]
    table, n = blocks(df, key, text, carry)

    def send_symbols(block: Block):
        names, _, twice = Windows(block).names()
        yield from sent(block.number, _shard(names, n), n, names.astype(np.uint32), twice.astype(np.uint8))

    def shared(names, twice):
        _, place = np.unique(names, return_inverse=True)
        return (np.bincount(place) + np.bincount(place, weights=twice))[place] > 1

    told = ask(table, send_symbols, shared, ["u4", "u1"], n)

    def candidates(block: Block):
        w = Windows(block)
        names, place, twice = w.names()
        return w, *w.distinct((bits_of(block.told["told_shared"], _shard(names, n), n) | twice)[place])

    def send_windows(block: Block):
        w, _, first, _ = candidates(block)
        yield from sent(block.number, _shard(w.hash[first], n), n, w.hash[first], w.ids[w.doc[first]])

    earlier = ask(with_answers(table, shared=told), send_windows, _started_before, ["u8", "i8"], n)

    def rebuild(batches):
        for block in rows_of(batches):
            w, own, first, place = candidates(block)
            again = bits_of(block.told["told_earlier"], _shard(w.hash[first], n), n)[place] | (own != first[place])
            gone = w.start[own[again]]
            depth = np.zeros(w.n_words + WINDOW + 1, np.int64)
            depth[gone] += 1
            depth[gone + WINDOW] -= 1
            keep = np.cumsum(depth)[: w.n_words] == 0
            kept = np.zeros(w.n_words + 1, np.int64)
            np.cumsum(keep, out=kept[1:])
            total = np.diff(w.bounds)
            removed = total - (kept[w.bounds[1:]] - kept[w.bounds[:-1]])
            texts = []
            for i, t in enumerate(w.texts.cast(pa.binary()).to_pylist()):
                words = t.split()
                texts.append(b" ".join(compress(words, keep[w.bounds[i] : w.bounds[i + 1]].tolist()) if removed[i] else words))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), block.rest.take(pa.array(w.order))], ["text", "n_words", "n_removed", "rest"])

    kind = table.schema["rest"].dataType.elementType.simpleString()
    out = with_answers(table, shared=told, earlier=earlier).mapInArrow(rebuild, f"text string, n_words long, n_removed long, rest {kind}")
    kept = {c: F.col(f"rest.k{i}").alias(c) for i, c in enumerate(carry)} | {text: F.col("text").alias(text)}
    return out.select(*(kept[c] for c in df.columns if c in kept), "n_words", "n_removed")
