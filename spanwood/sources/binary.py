"""The binary form of node trees: a 12-byte header (size, name, type), then data or children; and its hex writing."""

import re
import struct

from ..types import TYPES
from .tree import Node

HEADER = 12
_HEAD = struct.Struct(">I4s4s")
_CODES = {code.encode(): code for code in TYPES}


class BinaryError(ValueError):
    """Bytes that aren't node trees."""


def read_binary(data: bytes, strict: bool = False) -> list[Node]:
    """All top-level trees. A container that the data's end cuts between two children is accepted unless strict."""
    roots: list[Node] = []
    open_: list[tuple[int, Node]] = []
    at = 0
    while at < len(data):
        if at + HEADER > len(data):
            raise BinaryError(f"header cut short at byte {at}")
        size, raw, code = _HEAD.unpack_from(data, at)
        code = _CODES.get(code) or code.decode("latin-1")
        if size < HEADER:
            raise BinaryError(f"size {size} at byte {at} is less than a header's")
        end = at + size
        if open_ and end > open_[-1][0]:
            raise BinaryError(f"node at byte {at} reaches beyond its container")
        if code not in TYPES:
            raise BinaryError(f"unknown type {code!r} at byte {at}")
        if code == "CONT":
            node = Node(raw, code, b"", [])
            at += HEADER
        else:
            if end > len(data):
                raise BinaryError(f"data cut short at byte {at}: {end - len(data)} bytes are missing")
            width = TYPES[code].width
            own = data[at + HEADER : end]
            if width is not None:
                if len(own) < width:
                    raise BinaryError(f"invalid byte count for type {code}: want {width}, got {len(own)}")
                own = own[:width]  # what is more than the type holds is dropped
            node = Node(raw, code, own, None)
            at = end
        (open_[-1][1].children if open_ else roots).append(node)
        if code == "CONT":
            open_.append((end, node))
        while open_ and open_[-1][0] <= at:
            open_.pop()
    if open_ and strict:
        raise BinaryError("the last container is cut short")
    return roots


def read_hex(text: str, strict: bool = False) -> list[Node]:
    """Trees from hexadecimal digits, with or without 0x; bytes whose halves are swapped in pairs are tried as well."""
    digits = re.sub(r"[\n\r ]", "", text)
    if digits[:2] in ("0x", "0X"):
        digits = digits[2:]
    if len(digits) % 2:
        raise BinaryError("hex input has an odd number of digits")
    try:
        data = bytes.fromhex(digits)
    except ValueError:
        raise BinaryError("hex input has other characters than digits") from None
    try:
        return read_binary(data, strict)
    except BinaryError:
        if len(data) % 2:
            raise
        swapped = bytearray(data)
        swapped[::2], swapped[1::2] = data[1::2], data[::2]
        return read_binary(bytes(swapped), strict)


def write_binary(node: Node) -> bytes:
    body = node.data if node.children is None else b"".join(map(write_binary, node.children))
    return struct.pack(">I4s4s", HEADER + len(body), node.raw, node.type.encode("latin-1")) + body
