"""The node table with its operators as methods, and the functions that SQL can call."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .functions import columns
from .operators import bodies, navigate, sinks
from .plans.compile import select
from .sources import files, tables
from .types import DOCUMENT, NODES


class Forest:
    """Documents of nodes. Every operator works within a document, so a table partitioned by doc_id needs no shuffle."""

    def __init__(self, nodes: DataFrame, kinds: dict[str, set[str]] | None = None, tree: tables.Tree | None = None):
        """`tree`: the tables that the nodes are of, if they are; whole documents are then written from these."""
        self.nodes, self.kinds, self.tree = nodes, kinds or {}, tree if bodies.writable(tree) else None

    @classmethod
    def read(cls, spark: SparkSession, path: str | list[str], form: str = "auto", **options) -> "Forest":
        return cls(files.read_nodes(spark, path, form, **options))

    @classmethod
    def parse(cls, df: DataFrame, doc_id: str, content: str, form: str = "auto", **options) -> "Forest":
        return cls(files.parse_column(df, doc_id, content, form, **options))

    @classmethod
    def of_table(cls, name: str, table: DataFrame, key, fields: list[tables.Field], rows: tables.Rows | None = None) -> "Forest":
        return cls(tables.tree_of(name, table, key, fields, rows), tables.kinds_of(name, fields, rows), tables.Tree(name, table, key, fields, rows))

    def path(self, path: str, strict_less: bool = False) -> DataFrame:
        """The nodes that a path finds, with their order in `seq`."""
        return select(self.nodes, path, strict_less, self.kinds)

    def ordered(self, path: str) -> DataFrame:
        return self.path(path).orderBy(*DOCUMENT, "seq")

    def texts(self, path: str) -> DataFrame:
        """`name:type:value` of what a path finds, in order."""
        return self.ordered(path).select(*DOCUMENT, "text")

    def children(self, parents: DataFrame) -> DataFrame:
        return navigate.children(self.nodes, parents)

    def descendants(self, tops: DataFrame) -> DataFrame:
        return navigate.descendants(self.nodes, tops)

    def subtrees(self, tops: DataFrame) -> "Forest":
        """The found nodes as documents of their own, numbered in their order."""
        own = tops.withColumn("found", F.row_number().over(_within("seq")))
        found = navigate.descendants(self.nodes, own)
        numbered = own.select(*DOCUMENT, F.col("node_id").alias("top_id"), "found", F.col("depth").alias("above"))
        out = found.join(numbered, [*DOCUMENT, "top_id"])
        shift = {c: (F.col(c) - F.col("top_id")).alias(c) for c in ("node_id", "parent_id", "last_desc")}
        shift |= {"root_ord": F.col("found").cast("int").alias("root_ord"), "depth": (F.col("depth") - F.col("above")).alias("depth"), "path": F.slice("path", F.col("above") + 1, F.size("path")).alias("path")}
        return Forest(out.select(*(shift.get(c, F.col(c)) for c in self.nodes.columns)))

    def to_text(self) -> DataFrame:
        return bodies.written(self.tree, "text") if self.tree else sinks.to_text(self.nodes)

    def to_binary(self) -> DataFrame:
        return bodies.written(self.tree, "binary") if self.tree else sinks.to_binary(self.nodes)

    def to_hex(self) -> DataFrame:
        return sinks.hex_of(self.to_binary())

    def to_xml(self, namespace: str = "") -> DataFrame:
        return bodies.written(self.tree, "xml", sinks.xml_head(namespace)) if self.tree else sinks.to_xml(self.nodes, namespace)

    def to_debug(self) -> DataFrame:
        return sinks.to_debug(self.nodes)

    def lengths(self) -> DataFrame:
        return sinks.encoded_lengths(self.nodes)

    def document_lengths(self) -> DataFrame:
        return bodies.lengths(self.tree) if self.tree else sinks.document_lengths(self.nodes)


def _within(order: str):
    return Window.partitionBy(*DOCUMENT).orderBy(order)


class _Parse:
    """Rows of the node table that a content holds."""

    def eval(self, doc_id: str, content: bytes, form: str):
        batch = files.flattened([(doc_id, bytes(content))], form, False, False)
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield row


def register(spark: SparkSession) -> None:
    """For SQL: node_text(type, data), node_data(type, text), and the table function parse_nodes(doc_id, content, form)."""
    spark.udf.register("node_text", columns.text_of)
    spark.udf.register("node_data", columns.encode_text)
    spark.udtf.register("parse_nodes", udtf(_Parse, returnType=NODES))
