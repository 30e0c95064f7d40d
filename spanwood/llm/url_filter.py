"""Operator 1: URL filters by a bit-parallel wildcard automaton.

Rules are globs over the canonical URL ``.host/path``: ``*`` stands for any bytes but ``/`` and ``**`` for any
bytes. Every glob's positions are bits of multiword Shift-And masks. One step reads one byte of each URL:
``D = (((D << 1) | starts) & B[byte]) | (D & L[byte])``, with B the positions that the byte may enter and L the
wildcards that it may stay in, so all globs run at once over each URL, and all URLs of a batch beside each other.

The canonical URL: host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path is what follows up to ``?``, ``#`` or the end. A rule (host, path) fits its host and all
subdomains, if the path starts with the rule's; the longest rule that fits wins, at equal lengths the first given.

Defined cases: a null URL or one without ``://`` has an empty host and path, and no rule fits an empty host;
without a fitting rule the verdict is `default`; repeated rows are judged alike; all columns of the table stay,
but those named as the new ones are replaced; an empty table gives an empty one.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship
from .words import buffers

U = np.uint64
ANY, WITHIN = object(), object()  # ** and *


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def glob(self) -> list:
        """`*.` before the host, which the canonical URL's leading dot serves, too; `**` at the end."""
        return [WITHIN, *b"." + self.host.lower().encode() + self.path.encode(), ANY]


class Automaton:
    def __init__(self, globs: list[list]):
        size = sum(map(len, globs))
        self.words = max(1, (size + 63) // 64)
        enter, stay = np.zeros((256, self.words), U), np.zeros((256, self.words), U)
        self.begin, self.final = np.zeros(self.words, U), []
        empty = np.zeros(self.words, U)  # wildcards, which may also match nothing
        at = 0
        for glob in globs:
            for i, x in enumerate(glob):
                word, bit = divmod(at, 64)
                bit = U(1 << bit)
                if isinstance(x, int):
                    enter[x, word] |= bit
                else:
                    every = np.ones(256, bool)
                    every[47] = x is ANY
                    enter[every, word] |= bit
                    stay[every, word] |= bit
                    empty[word] |= bit
                if i == 0:
                    self.begin[word] |= bit
                at += 1
            self.final.append(divmod(at - 1, 64))
        self.enter, self.stay, self.empty = enter, stay, empty

    def _shift(self, d: np.ndarray) -> np.ndarray:
        out = d << U(1)
        out[:, 1:] |= d[:, :-1] >> U(63)
        return out

    def run(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each string, which globs match the whole of it."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        active = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), "right")
        d = np.zeros((len(sizes), self.words), U)
        first = offsets[:-1][order]
        last_bits = np.zeros(self.words, U)  # the glob before must not leak into the next one's first position
        for word, bit in self.final:
            last_bits[word] |= U(1 << bit)
        skipped = self.begin | self._shift((self.begin & self.empty)[None])[0]
        for t, n in enumerate(active):
            own = d[:n]
            byte = buf[first[:n] + t]
            moved = own & ~last_bits
            moved = self._shift(moved | ((self._shift(moved) & self.empty)))
            if t == 0:
                moved |= skipped
            d[:n] = (moved & self.enter[byte]) | (own & self.stay[byte])
        d |= self._shift(d & ~last_bits) & self.empty  # a wildcard at the end may match nothing
        out = np.zeros((len(sizes), len(self.final)), bool)
        for i, (word, bit) in enumerate(self.final):
            out[order, i] = (d[:, word] >> U(bit)) & U(1) > 0
        return out


def judge_urls(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """df and the columns host, path, rule (the winner's text or null) and verdict."""
    ship(df.sparkSession)
    rules = sorted(rules, key=lambda r: -len(r.text))  # stable
    automaton = Automaton([r.glob() for r in rules])
    texts, verdicts = np.array([*(r.text for r in rules), None], object), np.array([*(r.verdict for r in rules), default], object)
    u = F.col(f"`{url}`").cast("string")
    after = F.coalesce(F.when(F.instr(u, "://") > 0, u.substr(F.instr(u, "://") + 3, F.length(u))), F.lit(""))
    raw = F.regexp_extract(after, r"^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = F.struct(F.translate(raw, upper, lower).alias("host"), F.regexp_extract(after.substr(F.length(raw) + 1, F.length(after)), r"^[^?#]*", 0).alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            canonical = b.column("canonical")
            fits = automaton.run(*buffers(canonical)) if len(rules) else np.zeros((len(b), 0), bool)
            best = np.where(fits.any(axis=1), fits.argmax(axis=1) if len(rules) else 0, len(rules))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("parts"), pa.array(texts[best], pa.string()), pa.array(verdicts[best], pa.string())], ["row", "parts", "rule", "verdict"])

    new = ("host", "path", "rule", "verdict")
    carry = [c for c in df.columns if c not in new]
    row = F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(carry)))
    plain = df.select(row.alias("row"), parts.alias("parts"))
    plain = plain.withColumn("canonical", F.when(F.col("parts.host") == "", "").otherwise(F.concat(F.lit("."), "parts.host", "parts.path")))
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    out = plain.mapInArrow(judge, f"row {kinds['row']}, parts struct<host:string,path:string>, rule string, verdict string")
    return out.select(*(F.col(f"row.k{i}").alias(c) for i, c in enumerate(carry)), "parts.host", "parts.path", "rule", "verdict")


#: The rules of the registered query.
RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]
