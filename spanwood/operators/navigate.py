"""Moving about in the flattened table: children, descendants, counts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import DOCUMENT, NODES

_COLUMNS = NODES.fieldNames()


def children(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """The direct children of each of parents (rows of nodes); of a repeated parent repeatedly."""
    keys = parents.select(*DOCUMENT, F.col("node_id").alias("parent_id"))
    return nodes.join(keys, [*DOCUMENT, "parent_id"]).select(_COLUMNS)


def descendants(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Each top itself and all nodes under it, by pre-order intervals; top_id tells whose."""
    own = tops.select(F.col("doc_id").alias("top_doc"), F.col("root_ord").alias("top_root"), F.col("node_id").alias("top_id"), F.col("last_desc").alias("top_last"))
    on = (F.col("doc_id") == F.col("top_doc")) & (F.col("root_ord") == F.col("top_root")) & F.col("node_id").between(F.col("top_id"), F.col("top_last"))
    return nodes.join(own, on).select(*_COLUMNS, "top_id")


def n_children(nodes: DataFrame) -> DataFrame:
    """Each node's number of children; -1 for other types than containers."""
    return nodes.select(*DOCUMENT, "node_id", "name", "type", "n_children")


def n_descendants(nodes: DataFrame) -> DataFrame:
    """Each node's number of descendants, itself included."""
    return nodes.select(*DOCUMENT, "node_id", "name", (F.col("last_desc") - F.col("node_id") + 1).alias("n_descendants"))


def attribute_table(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Column-wise containers (a container a column, its AVAL an element a row) as a table: one row for each element."""
    depth = F.size("path")
    cells = nodes.where((depth == 4) & (F.element_at("path", 3) == "AVAL")).withColumn("attribute", F.element_at("path", 2))
    value = F.coalesce(F.col("u").cast("string"), F.col("i").cast("string"), F.col("f").cast("string"), F.col("s"))
    return cells.groupBy(*DOCUMENT, F.col("name_u32").alias("row")).pivot("attribute", names).agg(F.first(value, ignorenulls=True))
