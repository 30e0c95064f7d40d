"""Files of node trees as the flattened table: binary, hex, text and XML, told by their content or declared.

Files are read by Spark's binaryFile source, so any file system will do, in batch or as a stream; parsing runs in Arrow
batches. A file that can't be parsed fails the job, or with `errors="row"` gives one row whose `error` says why.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import NODES
from .binary import BinaryError, read_binary, read_hex
from .text import read_text
from .tree import Flat, Node
from .xml import read_xml

READERS = ("auto", "binary", "hex", "text", "xml")
BATCH_BYTES = 1 << 18  # of documents that are decoded together
MOST_ROWS = 10_000


def parse_bytes(data: bytes, form: str = "auto", strict: bool = False) -> list[Node]:
    """The top-level trees of a file's content."""
    if form == "auto":
        head = data[:64].lstrip()
        if len(data) >= 12 and int.from_bytes(data[:4], "big") == len(data):
            form = "binary"
        elif head[:2] in (b"0x", b"0X"):
            form = "hex"
        elif head.startswith(b"<"):
            form = "xml"
        else:
            form = "text" if b"\0" not in data else "binary"
    match form:
        case "binary":
            return read_binary(data, strict)
        case "hex":
            return read_hex(data.decode("ascii", "replace"), strict)
        case "text":
            return read_text(data.decode("utf-8"))
        case "xml":
            return read_xml(data)
    raise ValueError(f"unknown form {form}; one of {READERS}")


def flattened(documents: list[tuple[str, bytes]], form: str, exactly_one: bool, strict: bool) -> pa.RecordBatch:
    """The rows of all trees of some documents (id, content)."""
    out = Flat()
    for key, data in documents:
        try:
            roots = parse_bytes(data, form, strict)
            if exactly_one and len(roots) != 1:
                raise BinaryError("no nodes found" if not roots else f"{len(roots)} top-level nodes where one is wanted")
        except ValueError as e:
            raise ValueError(f"{key}: {e}") from e
        for n, root in enumerate(roots):
            out.add(root, key, n)
    return out.batch()


def parse_column(df: DataFrame, doc_id: str, content: str, form: str = "auto", exactly_one: bool = False, strict: bool = False, errors: str = "fail") -> DataFrame:
    """The nodes of the trees that a binary or string column holds, one document a row."""
    schema = T.StructType([*NODES.fields, T.StructField("error", T.StringType())])

    def tried(documents: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        """The documents' rows; if some can't be read, each document is tried by itself."""
        try:
            out = flattened(documents, form, exactly_one, strict)
            out = pa.RecordBatch.from_arrays([*out.columns, pa.nulls(len(out), pa.string())], [*out.schema.names, "error"])
        except ValueError as e:
            if len(documents) > 1:
                for one in documents:
                    yield from tried([one])
                return
            key = documents[0][0]
            message = str(e).removeprefix(f"{key}: ")
            if errors != "row":
                raise ValueError(f"{key}: {message}") from e
            kinds = Flat().batch().schema
            out = pa.RecordBatch.from_arrays([pa.array([key], pa.string()), *(pa.nulls(1, f.type) for f in list(kinds)[1:]), pa.array([message], pa.string())], [*kinds.names, "error"])
        for k in range(0, len(out), MOST_ROWS):
            yield out.slice(k, MOST_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for key, data in zip(b.column(0), b.column(1)):
                held.append((key.as_py(), data.as_py() or b""))
                size += len(held[-1][1])
                if size >= BATCH_BYTES:
                    yield from tried(held)
                    held, size = [], 0
            if held:
                yield from tried(held)

    out = df.select(F.col(doc_id).cast("string"), F.col(content).cast("binary")).mapInArrow(run, schema)
    return out if errors == "row" else out.drop("error")


def read_nodes(spark: SparkSession, path: str | list[str], form: str = "auto", **options) -> DataFrame:
    """The nodes of all files; doc_id is the file's path."""
    return parse_column(spark.read.format("binaryFile").load(path), "path", "content", form, **options)


def read_container_file(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of files that must each be one container whose size is the file's."""
    files = spark.read.format("binaryFile").load(path)
    sized = F.conv(F.hex(F.substring("content", 1, 4)), 16, 10).cast("long") == F.col("length")
    checked = files.withColumn("content", F.when(sized, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("size in header is not the file's: "), "path")).cast("binary")))
    return parse_column(checked, "path", "content", "binary", exactly_one=True)
