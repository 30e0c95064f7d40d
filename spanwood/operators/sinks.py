"""Node trees written: text, binary, hex, XML and a debug listing, one row for each document."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..types import DOCUMENT

TAB, LINE = "\t", "\n"


def _joined(parts: DataFrame, name: str, separator: str) -> DataFrame:
    """Pieces (column piece) of each document in the order of a, b, c. A document is the unit that a task holds."""
    ordered = F.sort_array(F.collect_list(F.struct("a", "b", "c", "piece")))
    return parts.groupBy(*DOCUMENT).agg(F.array_join(F.transform(ordered, lambda x: x.piece), separator).alias(name))


def _lines(nodes: DataFrame, opened: Column, closed: Column) -> DataFrame:
    """A line for each node, and one behind each container's last descendant, the innermost first."""
    one = nodes.select(*DOCUMENT, F.col("node_id").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), opened.alias("piece"))
    ends = nodes.where("type = 'CONT'").select(*DOCUMENT, F.col("last_desc").alias("a"), F.lit(1).alias("b"), (-F.col("depth")).alias("c"), closed.alias("piece"))
    return one.unionAll(ends)


def to_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, root_ord, body): canonical text, a tab for each level."""
    indent = F.repeat(F.lit(TAB), F.col("depth"))
    out = _joined(_lines(nodes, F.concat(indent, "text"), F.concat(indent, F.lit("END"))), "body", LINE)
    return out.withColumn("body", F.concat("body", F.lit(LINE)))


def _sized(nodes: DataFrame, **more: Column) -> DataFrame:
    """(doc_id, root_ord, node_id, length, ...): bytes of each node in the binary form, and other columns of it.

    A running sum over a document's nodes, in which each container shows up again behind its last descendant, so all is
    done within one partitioning by document.
    """
    own = F.octet_length("data").cast("long") + 12
    value = F.struct(F.lit(True).alias("is"), *(c.alias(k) for k, c in more.items()))
    one = nodes.select(*DOCUMENT, "node_id", F.col("node_id").alias("at"), own.alias("own"), value.alias("more"))
    ends = nodes.where("type = 'CONT'").select(*DOCUMENT, "node_id", F.col("last_desc").alias("at"), F.lit(0).cast("long").alias("own"))
    both = one.withColumn("is_end", F.lit(False)).unionByName(ends.withColumn("is_end", F.lit(True)), allowMissingColumns=True)
    summed = both.withColumn("upto", F.sum("own").over(Window.partitionBy(*DOCUMENT).orderBy("at", "is_end")))
    out = summed.groupBy(*DOCUMENT, "node_id").agg((F.max("upto") - F.min("upto") + F.max("own")).alias("length"), F.first("more", ignorenulls=True).alias("more"))
    return out.select(*DOCUMENT, "node_id", "length", *(F.col("more")[k].alias(k) for k in more))


def encoded_lengths(nodes: DataFrame) -> DataFrame:
    """(doc_id, root_ord, node_id, length): bytes of each node in the binary form, header and descendants included."""
    return _sized(nodes)


def document_lengths(nodes: DataFrame) -> DataFrame:
    """(doc_id, root_ord, length) of whole documents: one grouped sum."""
    return nodes.groupBy(*DOCUMENT).agg(F.sum(F.octet_length("data").cast("long") + 12).alias("length"))


def to_binary(nodes: DataFrame) -> DataFrame:
    """(doc_id, root_ord, body): header, data and children of each node, in pre-order."""
    rest = F.concat(F.lpad(F.hex("name_u32"), 8, "0"), F.hex(F.encode("type", "ISO-8859-1")), F.hex("data"))
    piece = F.concat(F.lpad(F.hex("length"), 8, "0"), "rest")
    parts = _sized(nodes, rest=rest).select(*DOCUMENT, F.col("node_id").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), piece.alias("piece"))
    return _joined(parts, "body", "").withColumn("body", F.unhex("body"))


def hex_of(binary: DataFrame) -> DataFrame:
    return binary.withColumn("body", F.concat(F.lit("0x"), F.hex("body")))


def to_hex(nodes: DataFrame) -> DataFrame:
    return hex_of(to_binary(nodes))


def to_debug(nodes: DataFrame) -> DataFrame:
    """Each node's text and its data's bytes, in two columns that are aligned within a document."""
    width = F.max(F.length("text")).over(Window.partitionBy(*DOCUMENT)) + 1
    spaced = F.regexp_replace(F.lower(F.hex("data")), "(..)(?!$)", "$1 ")
    piece = F.concat(F.rpad("text", width, " "), spaced)
    parts = nodes.select(*DOCUMENT, F.col("node_id").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), piece.alias("piece"))
    return _joined(parts, "body", LINE).withColumn("body", F.concat("body", F.lit(LINE)))


def _xml(s: Column) -> Column:
    for plain, named in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        s = F.replace(s, F.lit(plain), F.lit(named))
    return F.regexp_replace(s, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "�")


def xml_head(namespace: str = "") -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<containerxml version="1"{f" xmlns={chr(34)}{namespace}{chr(34)}" if namespace else ""}>\n'


def to_xml(nodes: DataFrame, namespace: str = "") -> DataFrame:
    """A document in the container form of XML; values stand undelimited, as attributes."""
    value = F.when(F.col("type").rlike("STR$|^IPAD$|^FC32$"), F.col("s")).otherwise(F.expr("substr(text, length(name) + 7)"))
    indent = F.repeat(F.lit(TAB), F.col("depth") + 1)
    name = F.concat(F.lit(' name="'), _xml(F.col("name")), F.lit('"'))
    atom = F.concat(indent, F.lit("<atom"), name, F.lit(' type="'), F.col("type"), F.lit('" value="'), _xml(value), F.lit('"></atom>'))
    opened = F.when(F.col("type") == "CONT", F.concat(indent, F.lit("<container"), name, F.lit(">"))).otherwise(atom)
    body = _joined(_lines(nodes, opened, F.concat(indent, F.lit("</container>"))), "body", LINE)
    return body.withColumn("body", F.concat(F.lit(xml_head(namespace)), "body", F.lit("\n</containerxml>\n")))


def write_text(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """The bodies as text files; an existing target is an error unless overwrite."""
    df.select(F.regexp_replace("body", "\n$", "")).write.mode("overwrite" if overwrite else "errorifexists").text(path)
