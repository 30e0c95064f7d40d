"""Operator 7: a quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes (the whole text is cut). A passage's features are the roots of its
byte shares, of the shares of pairs of neighbouring byte kinds, and of the shares of words that equal the word one or two before. A layer encodes every passage; gated attention
(tanh and sigmoid branches, multiplied) gives the passages' weights within their document, learnt from document labels
only; a logistic unit scores the weighted passage representation.

The model is fitted on the driver on at most SAMPLE labelled documents (those with the least hashes of their ids), with
at most MOST_PASSAGES passages of each, spread evenly; scoring uses every passage. The model has a fixed size.
Of rows that share a sampled id, the one whose text has the least hash is taken.

Defined cases: a null or empty text is one passage of zero features and gets a score like any other; labels with a null
id or label count for nothing; of a repeated label the mean decides; a row with a null id is scored, and isn't in the
held-out part; without labels of both kinds every score is the share of label 1 (0.5 without any); columns
beside the text stay, but those named as the new ones are replaced.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship
from .words import buffers, hash_spans, pieces, spans

PASSAGE = 1024
SAMPLE = 6000
MOST_PASSAGES = 24
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 24, 12, 40, 256, 0.01, 1e-4
THRESHOLD = 0.3
KINDS = 8
LAGS = 2
WIDTH = 256 + KINDS * KINDS + LAGS

_KIND = np.full(256, 7, np.uint8)  # 7: bytes of other scripts
_KIND[:128] = 5
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[32, 9, 11, 12, 13]], _KIND[10] = 3, 4
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 6


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and for each text where its passages start (n + 1 numbers)."""
    buf, offsets = buffers(texts)
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(counts)])
    n = int(first[-1])
    own = np.repeat(first[:-1], sizes)
    where = own + (np.arange(len(buf)) - np.repeat(offsets[:-1], sizes)) // PASSAGE
    single = np.bincount(where * 256 + buf, minlength=n * 256).reshape(n, 256)
    kind = _KIND[buf].astype(np.int64)
    same = where[1:] == where[:-1]
    double = np.bincount((where[1:] * KINDS + kind[:-1])[same] * KINDS + kind[1:][same], minlength=n * KINDS * KINDS).reshape(n, -1)
    total = np.maximum(1, single.sum(axis=1, keepdims=True))
    starts, ends = spans(buf, offsets)
    words, at = hash_spans(buf, starts, ends), where[starts]
    each = np.maximum(1, np.bincount(at, minlength=n))
    again = [np.bincount(at[lag:][(words[lag:] == words[:-lag]) & (at[lag:] == at[:-lag])], minlength=n) / each for lag in range(1, LAGS + 1)]
    shares = np.concatenate([single / total, double / total, np.stack(again, axis=1)], axis=1)
    return np.sqrt(shares).astype(np.float32), first


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def forward(self, x: np.ndarray, first: np.ndarray):
        """Scores of the bags that start at `first` (n + 1 numbers), and what the gradient needs."""
        h = np.tanh(x @ self.w + self.b)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * g) @ self.a
        sizes, at = np.diff(first), first[:-1]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), sizes))
        weight = e / np.repeat(np.add.reduceat(e, at), sizes)
        z = np.add.reduceat(weight[:, None] * h, at, axis=0)
        return 1 / (1 + np.exp(-(z @ self.c + self.d))), (h, t, g, weight, z)

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) * self.scale, first)[0] if len(first) > 1 else np.zeros(0)


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray) -> Model:
    """By Adam on the log loss of whole bags."""
    r = np.random.default_rng(7)
    mean = x.mean(axis=0) if len(x) else np.zeros(WIDTH, np.float32)
    scale = 1 / (x.std(axis=0) + 0.02) if len(x) else np.ones(WIDTH, np.float32)
    share = float(y.mean()) if len(y) else 0.5
    shapes = [(WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), (1,)]
    p = [(r.normal(size=s) / np.sqrt(s[0])).astype(np.float32) for s in shapes]
    p[1][:] = 0
    p[6][:] = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    if not len(y) or not 0 < share < 1:
        p[5][:] = 0
        return Model(mean, scale, *p)
    x = (x - mean) * scale
    m1, m2, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(y))
        for i in range(0, len(y), BATCH):
            bags = order[i : i + BATCH]
            sizes = (first[1:] - first[:-1])[bags]
            at = np.concatenate([[0], np.cumsum(sizes)])
            rows = np.repeat(first[bags] - at[:-1], sizes) + np.arange(at[-1])
            model, own = Model(mean, scale, *p), x[rows]
            out, (h, t, g, weight, z) = model.forward(own, at)
            err = ((out - y[bags]) / len(bags)).astype(np.float32)
            spread = np.repeat(err, sizes)[:, None] * model.c
            dh = weight[:, None] * spread
            pull = ((h - np.repeat(z, sizes, axis=0)) * spread).sum(axis=1) * weight
            dtg = pull[:, None] * model.a
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            dh += dt @ model.v.T + dg @ model.u.T
            dp = dh * (1 - h * h)
            grads = [own.T @ dp, dp.sum(axis=0), h.T @ dt, h.T @ dg, (t * g).T @ pull, z.T @ err, err.sum(keepdims=True)]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, q in enumerate(grads):
                q = q + DECAY * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * q
                m2[k] = 0.999 * m2[k] + 0.001 * q * q
                p[k] = (p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, *p)


def held_out(key: str):
    """crc32 of the id's digits, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model of the labelled documents that aren't held out."""
    ship(documents.sparkSession)
    known = labels.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y")).where(~held_out("id"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)  # a bounded number of ids
    own = documents.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(chosen), "id")
    own = own.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")).select("id", "y", "first.text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in pieces(b.column("text")):
                x, first = passages(b.column("text").slice(i, j - i))
                data = []
                for k in range(j - i):
                    bag = x[first[k] : first[k + 1]]
                    if len(bag) > MOST_PASSAGES:
                        bag = bag[np.linspace(0, len(bag) - 1, MOST_PASSAGES).astype(int)]
                    data.append(bag.astype(np.float16).tobytes())
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), b.column("y").slice(i, j - i), pa.array(data, pa.binary())], ["id", "y", "x"])

    rows = own.mapInArrow(encode, "id long, y double, x binary").collect()  # a row for each id
    rows.sort(key=lambda r: r.id)
    bags = [np.frombuffer(r.x, np.float16).reshape(-1, WIDTH) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    x = np.concatenate(bags).astype(np.float32) if bags else np.zeros((0, WIDTH), np.float32)
    return fit(x, first, np.array([r.y for r in rows], np.float32))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df and the columns held_out, score and predicted."""
    ship(df.sparkSession)
    carry = [c for c in df.columns if c not in ("held_out", "score", "predicted")]
    plain = df.select(F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(carry))).alias("row"), F.col(f"`{text}`").cast("string").alias("text"), held_out(key).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in pieces(b.column("text"), 1 << 19):
                values = np.round(model.scores(*passages(b.column("text").slice(i, j - i))).astype(np.float64), 6)
                yield pa.RecordBatch.from_arrays([b.column("row").slice(i, j - i), b.column("held_out").slice(i, j - i), pa.array(values, pa.float64())], ["row", "held_out", "score"])

    out = plain.mapInArrow(run, f"row {plain.schema['row'].dataType.simpleString()}, held_out boolean, score double")
    kept = [F.col(f"row.k{i}").alias(c) for i, c in enumerate(carry)]
    return out.select(*kept, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
