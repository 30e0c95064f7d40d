"""Operator 10: secret scans by one combined deterministic automaton.

All rules' regular expressions become one minimal automaton (see `automata`). No rule spans a line break, so the
lines of a batch are scanned beside each other: one step reads one byte of every line, with two array look-ups,
whatever the number of rules. Lines on which some rule ends in an accepting state (few) are then walked with the
anchored automaton of the same rules, which gives each kind's leftmost, longest, non-overlapping spans. A walk stops
where no kind that is free can be met any more, and where an earlier one passed in the same state in vain.

Spans of the kinds assign, access and hex are those of the fixed patterns below that are long enough; a match that
is too short is dropped, but what it covers isn't looked at again for its kind. The other kinds are added.

Defined cases: a null or empty text has no spans; offsets are code points, the end is exclusive; a text of any length
is scanned whole; equal texts have equal spans; the table's columns stay, but `spans` is replaced.
"""

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Dfa
from .store import ship
from .words import buffers, pieces


class Rule(NamedTuple):
    kind: str
    pattern: str
    fold: bool
    least: int  # bytes that a match needs, after `value`
    value: str  # the bytes that end the part before the value; "" if the whole match is the value
    scan: str  # what the first pass looks for: some part of every match that is long enough


#: The kinds in the order in which spans at one start are listed, with their patterns and least lengths.
RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", True, 12, "assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]"""),
    Rule("access", r"AKIA[A-Z0-9]+", False, 18, "", r"AKIA[A-Z0-9]"),
    Rule("hex", r"[0-9a-f]+", False, 16, "", r"[0-9a-f]{16}"),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", False, 1, "", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", False, 1, "", r"gh[pousr]_[A-Za-z0-9]"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]{10,}", False, 1, "", r"xox[abprs]-[A-Za-z0-9\-]"),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", False, 1, "", r"eyJ[A-Za-z0-9_\-]+\."),
]
BASE = ("assign", "access", "hex")
LONG_LINE = 2048


class Scanner:
    def __init__(self, rules: list[Rule] = RULES):
        self.rules = rules
        self.search = Dfa([(r.scan, r.fold) for r in rules], search=True)
        self.exact = Dfa([(r.pattern, r.fold) for r in rules])
        n = self.search.table.shape[1]
        self.flat = (self.search.table * n).astype(np.int32).ravel()
        self.classes = self.search.classes.astype(np.int32)
        self.accepting = {int(s) * n for s in np.flatnonzero(self.search.accepts)}
        self.accept = np.zeros(self.search.table.shape[0] * n, bool)
        self.accept[list(self.accepting)] = True
        self.one_list = self.flat.tolist()
        self.walk = [[None if t == self.exact.dead else t for t in row] for row in self.exact.table[:, self.exact.classes].tolist()]
        self.live = self.exact.live.tolist()
        self.ends = [[i for i in range(len(rules)) if m >> i & 1] for m in self.exact.accepts.tolist()]
        self.starts = np.array([x is not None for x in self.walk[0]])
        self.seen: dict[bytes, list] = {}

    def flagged(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The lines on which some rule is met."""
        sizes = end - start
        order = np.argsort(-sizes, kind="stable")
        order = order[np.searchsorted(-sizes[order], -LONG_LINE) :]
        codes = self.classes[buf]
        state = np.zeros(len(order), np.int32)
        first = start[order]
        counts = np.searchsorted(-sizes[order], -np.arange(1, (sizes[order].max() if len(order) else 0) + 1), "right")
        for t, n in enumerate(counts.tolist()):
            state[:n] = self.flat[state[:n] + codes[first[:n] + t]]
        out = np.zeros(len(sizes), bool)
        out[order] = self.accept[state]
        table, done = self.one_list, self.accepting
        for i in np.flatnonzero(sizes > LONG_LINE):
            s = 0
            for c in codes[start[i] : end[i]].tolist():
                s = table[s + c]
            out[i] = s in done
        return out

    def spans(self, line: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes."""
        if (known := self.seen.get(line)) is not None:
            return known
        found, free = [], [0] * len(self.rules)
        fruitless: dict[int, int] = {}  # by place, the state in which a walk passed it that met no rule from there on
        places = np.flatnonzero(self.starts[np.frombuffer(line, np.uint8)]).tolist() if line else []
        for at in places:
            active = sum(1 << r for r, end in enumerate(free) if at >= end)
            s, last, passed, over = 0, {}, [], True
            for p in range(at, len(line)):
                s = self.walk[s][line[p]]
                if s is None or fruitless.get(p) == s:
                    break
                if not self.live[s] & active:
                    over = False
                    break
                passed.append(s)
                for r in self.ends[s]:
                    last[r] = p + 1
            if over:
                barren = max(last.values(), default=at) - at
                fruitless.update(enumerate(passed[barren:], at + barren))
            for r, end in last.items():
                if at >= free[r]:
                    free[r] = end
                    rule = self.rules[r]
                    if end - self._value(rule, line, at, end) >= rule.least:
                        found.append((at, r, end))
        found.sort()
        if len(line) <= LONG_LINE:
            if len(self.seen) > 20_000:
                self.seen.clear()
            self.seen[line] = found
        return found

    @staticmethod
    def _value(rule: Rule, line: bytes, at: int, end: int) -> int:
        """Where the value starts: after the first : or = and what may stand behind it."""
        if not rule.value:
            return at
        p = min(x for x in (line.find(b":", at, end), line.find(b"=", at, end)) if x >= 0) + 1
        while line[p : p + 1] == b" ":
            p += 1
        return p + (line[p : p + 1] in (b'"', b"'"))


@cache
def scanner() -> Scanner:
    return Scanner()


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """df and the column spans: (kind, start, end) by start, then kind as listed."""
    ship(df.sparkSession)
    carry = [c for c in df.columns if c != "spans"]
    plain = df.select(F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(carry))).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))

    scan = scanner()  # compiled here once; the executors get its arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in pieces(b.column("text")):
                texts = b.column("text").slice(i, j - i)
                buf, offsets = buffers(texts)
                breaks = np.flatnonzero(buf == 10)
                start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
                end = np.append(start[1:], len(buf))
                out = [[] for _ in range(j - i)]
                points_at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                for k in np.flatnonzero(scan.flagged(buf, start, end)):
                    doc = int(np.searchsorted(offsets, start[k], "right")) - 1
                    if found := scan.spans(buf[start[k] : end[k]].tobytes()):
                        points = points_at[start[k] : end[k] + 1] - points_at[offsets[doc]]
                        out[doc] += [{"kind": scan.rules[r].kind, "start": int(points[s]), "end": int(points[e])} for s, r, e in found]
                yield pa.RecordBatch.from_arrays([b.column("row").slice(i, j - i), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["row", "spans"])

    out = plain.mapInArrow(run, f"row {plain.schema['row'].dataType.simpleString()}, spans {SPANS}")
    return out.select(*(F.col(f"row.k{i}").alias(c) for i, c in enumerate(carry)), "spans")
