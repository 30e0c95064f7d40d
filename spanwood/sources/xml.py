"""The XML form: <containerxml> with nested <container name> and <atom name type value>."""

from xml.etree import ElementTree

from ..functions import codec
from ..types import raw_of
from .tree import Node


def _plain(code: str, value: str) -> bytes:
    """Values stand undelimited in XML."""
    if code in ("CSTR", "USTR", "IPAD"):
        return codec.encode_value(code, value)
    return codec.encode_text(code, value)


def _node(e: ElementTree.Element) -> Node:
    tag = e.tag.rpartition("}")[2]
    if tag == "container":
        return Node(raw_of(e.attrib["name"]), "CONT", b"", [_node(x) for x in e])
    if tag != "atom":
        raise ValueError(f"unexpected element <{tag}>")
    return Node(raw_of(e.attrib["name"]), e.attrib["type"], _plain(e.attrib["type"], e.attrib.get("value", "")), None)


def read_xml(data: bytes) -> list[Node]:
    try:
        top = ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise ValueError(f"malformed XML: {e}") from None
    return [_node(x) for x in top] if top.tag.rpartition("}")[2] == "containerxml" else [_node(top)]
