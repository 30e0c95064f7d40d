"""Operator 2: benchmark decontamination with a BM25 inverted index and block-max WAND.

The benchmark's items are indexed; an item's BM25 weights are divided by their sum, so an item that a passage holds
whole scores 1. All words of every item count. Items are grouped by length: up to FIRST_CLASS words, up to twice as many,
and so on. For each class, each document is cut into passages of twice the class's longest item's words, every one half
over the one before, so an item stands whole in some passage, and a huge item doesn't widen the passages of short ones.
Term statistics are those of all classes together. Every passage is a query: block-max WAND retrieves all items that
score at least `threshold`, skipping blocks of postings whose greatest weights can't reach it. (Before it, one pass
over all passages of a batch sums greatest weights by ranges of items over the rarer terms only, and drops passages
that can't reach the threshold even with all that the commoner terms can add to any item.) A retrieved item
is confirmed by the shares of its question's and its answer's word triples that the passage holds; the answer is what
follows the last question mark, or else the last quarter of the item.

Words are runs of letters and digits (and all bytes above 127), A-Z lower-cased. The benchmark is read in blocks of
about INDEX_BYTES of text at most, each indexed on the driver and sent to the executors, one pass over the documents for
each. Statistics and passage lengths are counted over the whole benchmark first, so blocks find what one index would.

Defined cases: a null or empty text has no passages; an item without words matches nothing, one of fewer than SHORT
words must be held whole (one word is an answer, and its empty question counts as held); repeated items are found each; repeated rows are judged alike; all columns stay, but `leaks` is
replaced; an empty benchmark or table gives no leaks.
"""

import math
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship, written
from .words import WEIGHT_LOWER, buffers, grams, hash_spans, pieces, spans

INDEX_BYTES = 8 << 20
THRESHOLD = 0.6
QUESTION, ANSWER = 0.5, 0.4
SHORT = 8
K1, B = 1.2, 0.75
POSTINGS = 8  # in a block
RANGE = 2  # items whose greatest weights the first pass takes together
MOST_RANGES = 128
COMMON = 0.1  # of an item's weight, that the terms left out of the first pass may have
FIRST_CLASS = 512  # words of an item of the first length class; each further class reaches twice as far

_GAP = np.ones(256, bool)
_GAP[128:] = False
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offsets = buffers(texts)
    starts, ends = spans(buf, offsets, _GAP)
    return hash_spans(buf, starts, ends, WEIGHT_LOWER), np.searchsorted(starts, offsets)


def _triples(words: np.ndarray) -> np.ndarray:
    return np.unique(grams(words, min(3, len(words))) if len(words) else words)


def _class(size: int) -> int:
    return ((size - 1) // FIRST_CLASS).bit_length()


def _with_words(items: list[tuple[int, str]]) -> list[tuple[int, str, np.ndarray]]:
    """The items that have words, and these."""
    words, at = _words(pa.array([t or "" for _, t in items], pa.string()))
    return [(i, t, words[s:e]) for (i, t), s, e in zip(items, at[:-1], at[1:]) if e > s]


class Totals(NamedTuple):
    """Of a whole benchmark: its items that have words, their mean length, each length class's longest, and how many items have each term."""

    n: int
    mean: float
    longest: dict[int, int]
    terms: np.ndarray
    df: np.ndarray

    @classmethod
    def of(cls, kept: list[tuple[int, str, np.ndarray]]) -> "Totals":
        sizes = sorted(len(w) for _, _, w in kept)
        terms, df = np.unique(np.concatenate([np.unique(w) for _, _, w in kept]), return_counts=True) if kept else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return cls(len(sizes), sum(sizes) / len(sizes) if sizes else 1.0, {_class(n): n for n in sizes}, terms, df)


class Index:
    def __init__(self, items: list[tuple[int, str]], totals: Totals | None = None):
        kept = _with_words(items)
        totals = totals or Totals.of(kept)
        self.ids = [i for i, _, _ in kept]
        self.size = max([1, *(totals.longest[_class(len(w))] for _, _, w in kept)])
        self.parts = []
        for _, text, w in kept:
            cut = len(_words(pa.array([text[: text.rindex("?") + 1]]))[0]) if "?" in text else len(w)
            if not 0 < cut < len(w):
                cut = len(w) - max(1, len(w) // 4)
            self.parts.append((_triples(w[:cut]), min(3, cut), _triples(w[cut:]), min(3, len(w) - cut), len(w)))
        self.terms = np.unique(np.concatenate([w for _, _, w in kept])) if kept else np.zeros(0, np.uint64)
        found = [np.unique(np.searchsorted(self.terms, w), return_counts=True) for _, _, w in kept]
        df = totals.df[np.searchsorted(totals.terms, self.terms)].astype(np.float64)
        idf = np.log(1 + (totals.n - df + 0.5) / (df + 0.5))
        self.lists: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        width = max(RANGE, -(-len(kept) // MOST_RANGES))
        self.ranges = np.zeros((len(self.terms), max(1, -(-len(kept) // width))), np.float32)
        weights = []
        for item, ((t, tf), (_, _, w)) in enumerate(zip(found, kept)):
            weight = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / totals.mean))
            weight /= weight.sum()
            np.maximum.at(self.ranges, (t, item // width), weight.astype(np.float32))
            weights.append((t, weight))
            for x, v in zip(t.tolist(), weight.tolist()):
                self.lists[x].append((item, v))
        self.items = [[i for i, _ in own] for own in self.lists]
        self.top = [max(v for _, v in own) for own in self.lists]
        self.blocks = [[(own[min(k + POSTINGS, len(own)) - 1][0], max(v for _, v in own[k : k + POSTINGS])) for k in range(0, len(own), POSTINGS)] for own in self.lists]
        place = np.empty(len(self.terms), np.int64)  # commonest terms first
        place[np.argsort(-df, kind="stable")] = np.arange(len(self.terms))
        self.rare, self.added = np.ones(len(self.terms), bool), 0.0
        if kept:  # as many of the commonest as together add at most COMMON to any item
            sums = [(place[t][order], np.cumsum(w[order])) for t, w in weights for order in [np.argsort(place[t])]]
            cut = min(int(p[i]) if (i := int(np.searchsorted(c, COMMON, "right"))) < len(p) else len(self.terms) for p, c in sums)
            self.rare = place >= cut
            self.added = max(float(c[i - 1]) if (i := int(np.searchsorted(p, cut))) else 0.0 for p, c in sums)
        self.slots = 1 << max(12, (4 * max(1, len(self.terms)) - 1).bit_length())
        self.table = np.full(self.slots, -1, np.int32)  # a first look-up by the hash's low bits; the rest is searched
        self.table[(self.terms & np.uint64(self.slots - 1)).astype(np.int64)] = 1

    def term_ids(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the words that some item has, and their terms."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.flatnonzero(self.table[(words & np.uint64(self.slots - 1)).astype(np.int64)] > 0)
        t = np.minimum(np.searchsorted(self.terms, words[near]), len(self.terms) - 1)
        same = self.terms[t] == words[near]
        return near[same], t[same]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items that score at least threshold, by block-max WAND."""
        found, end = [], math.inf
        least = threshold * (1 - 1e-9)  # for bounds, whose sums' last bits depend on the order; a score's don't
        cursors = [[self.items[t][0], 0, 0, t] for t in terms]  # item, posting, block, term
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += self.top[c[3]]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, last = 0.0, end
            for c in cursors[: pivot + 1]:
                blocks = self.blocks[c[3]]
                while c[2] < len(blocks) and blocks[c[2]][0] < item:
                    c[2] += 1
                if c[2] < len(blocks):
                    bound += blocks[c[2]][1]
                    last = min(last, blocks[c[2]][0])
            if bound >= least and cursors[0][0] == item:
                score = math.fsum(self.lists[c[3]][c[1]][1] for c in cursors[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                goal = item + 1
            elif bound >= least:
                goal = item
            else:  # no item up to the nearest block's end, or to the next list's item, can reach it
                goal = last + 1
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0])
                goal = max(goal, item + 1)
            for c in cursors[: pivot + 1]:
                if c[0] < goal:
                    own = self.items[c[3]]
                    c[1] = bisect_left(own, goal, c[1])
                    c[0] = own[c[1]] if c[1] < len(own) else end
            cursors = [c for c in cursors if c[0] is not end]
        return found

    def leaks(self, words: np.ndarray, bounds: np.ndarray, threshold: float) -> list[list[tuple]]:
        """Of each text: (item id, score, question's share, answer's share), the best passage's for each item."""
        out: list[dict] = [{} for _ in range(len(bounds) - 1)]
        where, terms = self.term_ids(words)
        if not len(where):
            return [[] for _ in out]
        counts = np.maximum(1, -(-np.diff(bounds) // self.size))  # half passages of each text
        first = np.concatenate([[0], np.cumsum(counts)])
        doc = np.searchsorted(bounds, where, "right") - 1
        half = first[doc] + (where - bounds[doc]) // self.size
        keys = np.unique(half * len(self.terms) + terms)
        half, terms = np.divmod(keys, len(self.terms))
        starts = np.flatnonzero(np.concatenate([[True], half[1:] != half[:-1]]))
        sums = np.zeros((first[-1] + 1, self.ranges.shape[1]), np.float32)
        rare = np.flatnonzero(self.rare[terms])
        if len(rare):
            rare_starts = np.flatnonzero(np.concatenate([[True], half[rare[1:]] != half[rare[:-1]]]))
            sums[half[rare[rare_starts]]] = np.add.reduceat(self.ranges[terms[rare]], rare_starts, axis=0)
        ends = np.append(starts[1:], len(half))
        span = dict(zip(half[starts].tolist(), zip(starts.tolist(), ends.tolist())))
        inner = np.ones(first[-1], bool)
        inner[first[1:] - 1] = False
        both = sums[:-1] + np.where(inner[:, None], sums[1:], 0)
        slack = max(0.001, 4 * self.size * 6e-8)  # more than the error of a passage's sum in single precision
        for p in np.flatnonzero(both.max(axis=1) >= (threshold - self.added) * (1 - slack)).tolist():
            own = set()
            for h in (p, p + 1) if inner[p] else (p,):
                if h in span:
                    own.update(terms[slice(*span[h])].tolist())
            if found := self.search(sorted(own), threshold):
                d = int(np.searchsorted(first, p, "right")) - 1
                low = bounds[d] + (p - first[d]) * self.size
                passage = words[low : min(low + 2 * self.size, bounds[d + 1])]
                held: dict[int, np.ndarray] = {}
                for item, score in found:
                    question, q_size, answer, a_size, n = self.parts[item]
                    for size in {q_size, a_size} - held.keys():
                        held[size] = grams(passage, size)
                    q, a = (float(np.isin(part, held[size]).mean()) if size else 1.0 for part, size in ((question, q_size), (answer, a_size)))
                    if (q >= QUESTION and a >= ANSWER) if n >= SHORT else q == a == 1:
                        out[d][item] = max(out[d].get(item, (0.0,)), (round(score, 6), round(q, 6), round(a, 6)))
        return [[(self.ids[i], *v) for i, v in sorted(x.items())] for x in out]


def indexes(items: list[tuple[int, str]], totals: Totals | None = None) -> list[Index]:
    """An index of each length class's items."""
    kept = _with_words(items)
    totals = totals or Totals.of(kept)
    return [Index([(i, t) for i, t, w in kept if _class(len(w)) == c], totals) for c in sorted({_class(len(w)) for _, _, w in kept})]


def _order(leak: tuple) -> tuple:
    return leak[0] is not None, leak[0] or 0, *leak[1:]


def all_leaks(own: list[Index], texts: pa.Array, threshold: float) -> list[list[tuple]]:
    """What any of the indexes finds in each text, by item id."""
    words, bounds = _words(texts)
    found = [index.leaks(words, bounds, threshold) for index in own]
    return [sorted((x for one in found for x in one[d]), key=_order) for d in range(len(texts))]


def totals_by_block(items: DataFrame) -> tuple[Totals, DataFrame]:
    """The totals of items (block, text) but for terms, and the written table (block, term, df) of what each block's terms have in all blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in pieces(b.column("text")):
                words, at = _words(b.column("text").slice(i, j - i))
                for block, s, e in zip(b.column("block").slice(i, j - i).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    if e > s:  # the item itself, and its terms
                        own = pa.array(np.unique(words[s:e]).view(np.int64))
                        terms = pa.concat_arrays([pa.nulls(1, pa.int64()), own])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), block, np.int64)), terms, pa.array([e - s] + [None] * len(own), pa.int64())], ["block", "term", "size"])

    found = written(items.mapInArrow(count, "block long, term long, size long"), "benchmark-terms")
    sizes = found.where("term IS NULL").groupBy("size").agg(F.count("*").alias("n")).orderBy("size").collect()
    n = sum(r.n for r in sizes)
    totals = Totals(n, sum(r.size * r.n for r in sizes) / n if n else 1.0, {_class(r.size): r.size for r in sizes}, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    each = found.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"), F.collect_set("block").alias("blocks"))
    return totals, written(each.select(F.explode("blocks").alias("block"), "term", "df"), "benchmark-df")


LEAKS = "array<struct<item_id:long,score:double,question:double,answer:double>>"


def find_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df and the column leaks: the items that each text holds."""
    ship(df.sparkSession)
    items = benchmark.select(F.col(f"`{item}`").cast("long").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 4 * total // INDEX_BYTES + 1
    carry = [c for c in df.columns if c != "leaks"]
    out = df.select(F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(carry))).alias("row"), F.col(f"`{text}`").cast("string").alias("text"), F.lit(None).cast(LEAKS).alias("leaks"))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))
    if n > 1:
        items = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
        totals, counted = totals_by_block(items.select("block", "text"))
    for k in range(n):
        own = items.where(F.col("block") == k).drop("block") if n > 1 else items
        own_totals = None
        if n > 1:
            one = counted.where(F.col("block") == k).select("term", "df").toArrow()
            terms, df_ = (one.column(c).to_numpy() for c in ("term", "df"))
            order = np.argsort(terms.view(np.uint64))
            own_totals = totals._replace(terms=terms.view(np.uint64)[order], df=df_[order])
        built = indexes(sorted(map(tuple, own.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), own_totals)

        def run(batches: Iterator[pa.RecordBatch], built=built) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, j in pieces(b.column("text")):
                    piece = b.slice(i, j - i)
                    found = [[dict(zip(("item_id", "score", "question", "answer"), x)) for x in own] for own in all_leaks(built, piece.column("text"), threshold)]
                    before = piece.column("leaks").to_pylist()
                    yield pa.RecordBatch.from_arrays([piece.column("row"), piece.column("text"), pa.array([sorted((x or []) + y, key=lambda v: _order(tuple(v.values()))) if x else y for x, y in zip(before, found)], kind)], ["row", "text", "leaks"])

        out = out.mapInArrow(run, f"row {out.schema['row'].dataType.simpleString()}, text string, leaks {LEAKS}")
    return out.select(*(F.col(f"row.k{i}").alias(c) for i, c in enumerate(carry)), "leaks")


def drop_leaks(df: DataFrame, benchmark: DataFrame, **named) -> DataFrame:
    """The rows of df that hold no item, with df's columns."""
    if "leaks" in df.columns:
        kept = df.withColumnRenamed("leaks", "leaks before")
        return find_leaks(kept, benchmark, **named).where(F.size("leaks") == 0).drop("leaks").withColumnRenamed("leaks before", "leaks").select(df.columns)
    return find_leaks(df, benchmark, **named).where(F.size("leaks") == 0).drop("leaks")
