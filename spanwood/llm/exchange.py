"""Questions that blocks of documents put to shards of a key space.

`blocks` gathers consecutive documents into rows of about BLOCK_BYTES and writes them, which fixes every block's
number and content. `ask` lets each block send each shard one row with the keys that fall to it; the shard looks
at all blocks' keys together and gives back one bit for each key, in the order sent. A block sends a key once
however often it holds it, so a key that fills a third of all rows costs a shard no more than one entry for each
block, and no task ever gathers a group of documents.

Shards grow in number with the corpus, partitions up to MOST_PARTITIONS only, since a shuffle's bookkeeping grows with
both of its sides. A partition's questions are sorted by shard (which spills where it must) and answered shard by
shard, so a task holds one shard's entries, as packed arrays, whatever its partition holds.
"""

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship, written
from .words import pieces

BLOCK_BYTES = 1 << 20
SHARD_BYTES = 32 << 20  # one shard more for so much text
LEAST_SHARDS = 96
MOST_PARTITIONS = 1 << 15
REPLIES = 1 << 12  # replies a batch


class Block(NamedTuple):
    number: int
    ids: np.ndarray  # 0 where null
    known: np.ndarray  # False where the id is null
    texts: pa.Array
    rest: pa.Array | None
    told: dict[str, dict[int, bytes]]


def blocks(df: DataFrame, key: str, text: str, carry: list[str] = ()) -> tuple[DataFrame, int]:
    """(block, ids, texts, rest) rows, written, and the number of shards to use. carry: columns that `rest` keeps."""
    ship(df.sparkSession)
    rest = F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(carry))) if carry else F.lit(None).cast("struct<k0:int>")
    plain = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"), rest.alias("rest"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for b in batches:
            texts = b.column("text").fill_null("")
            for i, j in pieces(texts, BLOCK_BYTES):
                own = [pa.concat_arrays([x.slice(i, j - i)]) for x in (b.column("id"), texts, b.column("rest"))]
                lists = [pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), x) for x in own]
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([own[1].nbytes], pa.int64()), *lists], ["block", "bytes", "ids", "texts", "rest"])
                n += 1

    kind = plain.schema["rest"].dataType.simpleString()
    out = written(plain.mapInArrow(gather, f"block long, bytes long, ids array<long>, texts array<string>, rest array<{kind}>"), "blocks")
    total = out.agg(F.sum("bytes")).first()[0] or 0
    return out, max(LEAST_SHARDS, total // SHARD_BYTES)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        asked = [c for c in b.schema.names if c.startswith("told")]
        for r in range(len(b)):
            ids = b.column("ids")[r].values
            told = {c: {x["shard"]: x["bits"] for x in b.column(c)[r].as_py() or []} for c in asked}
            yield Block(b.column("block")[r].as_py(), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), b.column("texts")[r].values, b.column("rest")[r].values, told)


def _places(shard: np.ndarray, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(n_shards + 1))


def sent(block: int, shard: np.ndarray, n_shards: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each shard with the packed columns of its entries, in their order."""
    order, at = _places(shard, n_shards)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        data = [pa.array([c[order[at[s] : at[s + 1]]].tobytes() for s in full], pa.binary()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(np.full(len(full), block), pa.int64()), *data], ["shard", "block", *(f"c{i}" for i in range(len(columns)))])


def bits_of(told: dict[int, bytes], shard: np.ndarray, n_shards: int) -> np.ndarray:
    """The answers, in the order of the entries that `sent` got."""
    order, at = _places(shard, n_shards)
    out = np.zeros(len(shard), bool)
    for s, packed in told.items():
        out[order[at[s] : at[s + 1]]] = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(at[s + 1] - at[s])).astype(bool)
    return out


def _offsets(packed: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_binary(packed.type)
    return np.frombuffer(packed.buffers()[1], np.int64 if wide else np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)


def _packed(packed: pa.Array) -> memoryview:
    """The bytes of all values, one after the other."""
    at = _offsets(packed)
    return memoryview(packed.buffers()[2])[at[0] : at[-1]]


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Each shard with its slices of batches that are sorted by shard, which may end and begin anywhere in one."""

    def slices():
        for b in batches:
            shard = b.column("shard").to_numpy()
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
                if j > i:
                    yield int(shard[i]), b.slice(i, j - i)

    for shard, group in groupby(slices(), key=lambda x: x[0]):
        yield shard, (b for _, b in group)


def _gathered(parts: Iterator[pa.RecordBatch], names: list[str], kinds: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The blocks of a shard's slices, how many entries each sent, and the columns; no slice is held beyond the next."""
    number, size, data = [], [], [bytearray() for _ in names]
    for p in parts:
        number.append(p.column("block").to_numpy().copy())
        size.append(np.diff(_offsets(p.column("c0"))))
        for x, c in zip(data, names):
            x += _packed(p.column(c))
    return np.concatenate(number), np.concatenate(size) // np.dtype(kinds[0]).itemsize, [np.frombuffer(x, kind) for x, kind in zip(data, kinds)]


def ask(table: DataFrame, send: Callable[[Block], Iterator[pa.RecordBatch]], answer: Callable, kinds: list[str], n_shards: int) -> DataFrame:
    """(block, told) rows, written: the shards' answers to each block.

    send yields `sent` batches; answer gets, for one shard, each column's concatenation over all blocks in
    ascending order of block, and returns a bool for each entry.
    """
    names = [f"c{i}" for i in range(len(kinds))]

    def outgoing(batches):
        for block in rows_of(batches):
            yield from send(block)

    def resolve(batches):
        for shard, parts in _by_shard(batches):
            number, size, columns = _gathered(parts, names, kinds)
            yes = answer(*columns)
            end = np.cumsum(size)
            some = np.flatnonzero(np.add.reduceat(yes, end - size, dtype=np.int64))
            for i in range(0, len(some), REPLIES):
                own = some[i : i + REPLIES]
                bits = pa.array([np.packbits(yes[e - n : e]).tobytes() for e, n in zip(end[own].tolist(), size[own].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(number[own]), pa.array(np.full(len(own), shard)), bits], ["block", "shard", "bits"])

    fields = ", ".join(f"{c} binary" for c in names)
    replies = table.mapInArrow(outgoing, f"shard long, block long, {fields}").repartition(min(n_shards, MOST_PARTITIONS), "shard").sortWithinPartitions("shard", "block").mapInArrow(resolve, "block long, shard long, bits binary")
    return written(replies, "told").groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias("told"))


def with_answers(table: DataFrame, **told: DataFrame) -> DataFrame:
    """The blocks with the columns told_..., each from `ask`."""
    for name, replies in told.items():
        table = table.join(replies.withColumnRenamed("told", f"told_{name}").hint("merge"), "block", "left")  # the same plan at every size
    return table
