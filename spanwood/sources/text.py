"""The text form of node trees: ``NAME:TYPE:VALUE`` lines, containers closed by ``END``, ``#`` comments."""

import re

from ..functions import codec
from ..types import TYPES, raw_of
from .tree import Node

_LINE = re.compile(r"(0[xX][0-9A-Fa-f]{8}|[\x21-\x7E]{4}):(.{4})(?::(.*))?", re.S)


class TextError(ValueError):
    """Text that isn't a node document; the message has the line's number."""


def read_text(text: str) -> list[Node]:
    """The closed top-level trees of a document."""
    roots: list[Node] = []
    open_: list[Node] = []
    for number, line in enumerate(text.split("\n"), 1):
        line = line.strip(" \t\r") if not line.rstrip("\r").endswith('"') else line.lstrip(" \t").rstrip("\r")
        if not line or line[0] == "#":
            continue
        if line == "END":
            if not open_:
                raise TextError(f"line {number}: END without an open container")
            node = open_.pop()
            if not open_:
                roots.append(node)
            continue
        m = _LINE.fullmatch(line)
        if not m:
            raise TextError(f'line {number}: malformed line "{line}"')
        name, code, value = m[1], m[2], m[3]
        try:
            raw = raw_of(name)
            if code not in TYPES:
                raise ValueError(f"unknown type {code}")
            if code == "CONT":
                if value:
                    raise ValueError("a container has no value")
                node = Node(raw, code, b"", [])
            else:
                if value is None:
                    raise ValueError("value is missing")
                node = Node(raw, code, codec.encode_text(code, value), None)
        except ValueError as e:
            raise TextError(f"line {number}: {e}") from None
        if open_:
            open_[-1].children.append(node)
        elif code != "CONT":
            roots.append(node)
        if code == "CONT":
            open_.append(node)
    return roots
