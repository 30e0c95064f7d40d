"""Values of all node types: from bytes, to text, and from text or values to bytes.

`decode` gives the tagged value and the text form that stands in a text document; `encode_text` reads such text and
`encode_value` takes a host value. Errors are ValueErrors in the wording that users of the format know. These run in
Arrow batches; `columns` has the forms that stay within Spark's own functions.
"""

import math
import re
import struct
import uuid
from decimal import ROUND_HALF_EVEN, Decimal
from typing import Any, NamedTuple

import numpy as np

from ..types import TYPES, name_of, raw_of


class Value(NamedTuple):
    u: int | None = None
    i: int | None = None
    f: float | None = None
    s: str | None = None
    text: str = ""
    numbers: tuple = ()


def _bytes_error(code: str, want: int, got: int) -> ValueError:
    return ValueError(f"invalid byte count for type {code}: want {want}, got {got}")


def _range_error(code: str, value: Any) -> ValueError:
    return ValueError(f"value exceeds range of type {code}: {value}")


def _invalid(code: str, value: str) -> ValueError:
    return ValueError(f'invalid string value for type {code}: "{value}"')


# ---- bytes to values

_PLAIN = re.compile(rb'[ !#-\[\]-~]*\0')  # a null-terminated string whose text form is the same between quotes
_SPECIAL = re.compile(r'[\x00-\x1f"\\\x7f]')


def _escaped(s: str, raw: bytes | None = None) -> str:
    named = {"\n": "\\n", "\r": "\\r", "\\": "\\\\", '"': '\\"'}
    out = []
    for c in s:
        if c in named:
            out.append(named[c])
        elif ord(c) < 0x20 or ord(c) == 0x7F or 0xDC80 <= ord(c) <= 0xDCFF or raw is None and 0x80 <= ord(c) < 0xA0:
            out.append(f"\\x{ord(c) & 0xFF if ord(c) >= 0xDC80 else ord(c):02X}")  # a lone byte is kept as a low surrogate
        else:
            out.append(c)
    return '"' + "".join(out) + '"'


def _c_string(data: bytes) -> tuple[str, str]:
    at = data.find(b"\0")
    if at < 0:
        raise ValueError("CSTR data lacks null byte terminator")
    if at != len(data) - 1:
        raise ValueError("CSTR data contains illegal embedded null byte")
    s = data[:-1].decode("utf-8", "surrogateescape")
    plain = "".join(f"\\x{ord(c) & 0xFF:02X}" if 0xDC80 <= ord(c) <= 0xDCFF else c for c in s)
    return plain, _escaped(s, data)


def _wide_string(data: bytes) -> tuple[str, str]:
    if len(data) % 4:
        raise ValueError(f"invalid byte count for type USTR: want a multiple of 4, got {len(data)}")
    points = struct.unpack(f">{len(data) // 4}I", data)
    valid = [p < 0x110000 and not 0xD800 <= p < 0xE000 for p in points]
    plain = "".join(chr(p) if ok else f"\\x{p:02X}" for p, ok in zip(points, valid))
    return plain, _escaped("".join(chr(p) if ok else "�" for p, ok in zip(points, valid)))


def _fixed_text(data: bytes, signed: bool) -> tuple[float, str]:
    n, half = int.from_bytes(data, "big", signed=signed), 4 * len(data)
    if len(data) == 4:
        return n / 65536, str((Decimal(n) / 65536).quantize(Decimal("0.0001"), ROUND_HALF_EVEN))
    whole, part = divmod(abs(n), 1 << half)
    digits = round(part / (1 << half) * 1e9)  # may be ten digits; there is no carry
    return n / (1 << half), f"{'-' if n < 0 else ''}{whole}.{digits:09d}"


def _address(data: bytes) -> str:
    if len(data) < 4 or len(data) % 4:
        raise _bytes_error("IP32", 4, len(data))
    return ".".join(map(str, data)) if len(data) == 4 else f"0x{data.hex().upper()}"


def decode(code: str, data: bytes) -> Value:
    t = TYPES.get(code)
    if t is None:
        raise ValueError(f"unknown type {code}")
    if t.width is not None and len(data) != t.width:
        raise _bytes_error(code, t.width, len(data))
    signed = code[0] == "S" or t.family == "enum"
    match t.family:
        case "bool" | "unsigned":
            n = int.from_bytes(data, "big")
            if t.family == "bool" and n > 1:
                raise _range_error(code, n)
            return Value(u=n, text=str(n))
        case "signed":
            n = int.from_bytes(data, "big", signed=True)
            return Value(i=n, text=str(n))
        case "float":
            x = struct.unpack(">f" if t.width == 4 else ">d", data)[0]
            shown = "NaN" if math.isnan(x) else ("+Inf" if x > 0 else "-Inf") if math.isinf(x) else f"{x:.{8 if t.width == 4 else 17}E}"
            return Value(f=x, text=shown)
        case "unsigned fixed" | "signed fixed":
            x, shown = _fixed_text(data, signed)
            return Value(f=x, text=shown)
        case "unsigned fraction" | "signed fraction":
            half = len(data) // 2
            pair = tuple(int.from_bytes(part, "big", signed=signed) for part in (data[:half], data[half:]))
            shown = f"{pair[0]}/{pair[1]}"
            return Value(s=shown, text=shown, numbers=pair)
        case "four chars":
            shown = name_of(data)
            return Value(s=shown, text=shown if len(shown) == 10 else f"'{shown}'")
        case "enum":
            shown = str(int.from_bytes(data, "big", signed=True))
        case "uuid":
            shown = str(uuid.UUID(bytes=data)).upper()
        case "ip":
            shown = _address(data)
        case "ip text":
            if not data.endswith(b"\0"):
                raise _bytes_error(code, 1, 0)
            s = data[:-1].decode("utf-8", "replace")
            return Value(s=s, text=f'"{s}"')
        case "c string":
            s, shown = _c_string(data)
            return Value(s=s, text=shown)
        case "utf-32 string":
            s, shown = _wide_string(data)
            return Value(s=s, text=shown)
        case "bytes":
            shown = f"0x{data.hex().upper()}" if data else ""
        case _:
            shown = ""
    return Value(s=shown, text=shown)


def decode_all(code: str, data: list[bytes]) -> tuple[Any, list[str]]:
    """The values, of the kind that the type has, and the text forms of many data of one type."""
    t = TYPES[code]
    if t.kind == "s":
        if t.family == "container":
            return [""] * len(data), [""] * len(data)
        if t.family == "c string" and all(map(_PLAIN.fullmatch, data)):
            plain = [d[:-1].decode() for d in data]
            return plain, [f'"{x}"' for x in plain]
    elif t.family in ("bool", "unsigned", "signed", "float") and all(len(d) == t.width for d in data):
        kind = {"signed": "i", "float": "f"}.get(t.family, "u")
        values = np.frombuffer(b"".join(data), f">{kind}{t.width}")
        if kind != "f" and not (t.family == "bool" and (values > 1).any()):
            return values, [str(x) for x in values.tolist()]
        if kind == "f" and np.isfinite(values).all():
            return values.astype(np.float64), [f"%.{8 if t.width == 4 else 17}E" % x for x in values.tolist()]
    each = [decode(code, d) for d in data]
    return [v.s if t.kind == "s" else getattr(v, t.kind) for v in each], [v.text for v in each]


# ---- text to bytes

_INTEGER = re.compile(r"([+-]?)(?:0[xX]((?:_?[0-9a-fA-F])+)|0[bB]((?:_?[01])+)|0[oO]?((?:_?[0-7])+)|(0|[1-9](?:_?[0-9])*))")
_RADIX = {2: 16, 3: 2, 4: 8, 5: 10}


def integer(s: str) -> int:
    """An integer with an optional base prefix; a leading 0 alone means octal."""
    if s.isascii() and s.isdigit() and (s[0] != "0" or len(s) == 1):
        return int(s)
    m = _INTEGER.fullmatch(s)
    if not m:
        raise ValueError(s)
    k = next(k for k in _RADIX if m[k] is not None)
    return int(m[1] + m[k].replace("_", ""), _RADIX[k])


def _packed(code: str, n: int, width: int, signed: bool) -> bytes:
    try:
        return n.to_bytes(width, "big", signed=signed)
    except OverflowError:
        raise _range_error(code, n) from None


def _scaled(code: str, s: str) -> bytes:
    """Fixed-point text, cut after the unit that the type has."""
    width, signed = TYPES[code].width, code[0] == "S"
    m = re.fullmatch(r"([+-]?)(\d*)(?:\.(\d*))?", s)
    if not m or not (m[2] or m[3]):
        raise _invalid(code, s)
    if width == 8:
        part = Decimal(f"0.{(m[3] or '0')[:16]}").quantize(Decimal("0.000000000"), ROUND_HALF_EVEN)
        n = int(m[2] or 0) * (1 << 32) + int(part * (1 << 32))
    else:
        n = int((Decimal(m[2] or 0) + Decimal(f"0.{m[3] or 0}")) * 65536)
    if m[1] == "-":
        n = -n
    return _packed(code, n, width, signed) if signed or n >= 0 else _raise(_range_error(code, s))


def _raise(e: Exception):
    raise e


def _fraction(code: str, s: str) -> bytes:
    t, parts = TYPES[code], s.split("/")
    signed, half = code[0] == "S", TYPES[code].width // 2
    if len(parts) != 2:
        raise _invalid(code, s)
    try:
        num, den = map(integer, parts)
    except ValueError:
        raise _invalid(code, s) from None
    return pack_fraction(t.code, num, den, half, signed)


def pack_fraction(code: str, num: int, den: int, half: int, signed: bool) -> bytes:
    """Both halves added as one number, so a negative denominator lowers the numerator by one, as the format's encoder does."""
    if den == 0:
        raise ValueError(f'fractional type {code} forbids zero in denominator, got "{num}/{den}"')
    for x in (num, den):
        _packed(code, x, half, signed)
    return ((num << 8 * half) + den & (1 << 16 * half) - 1).to_bytes(2 * half, "big")


def unescape(code: str, s: str) -> str:
    """The text between the quotes without escapes; a lone ``\\xHH`` is the code point HH."""
    if not _SPECIAL.search(s):
        return s
    out, i = [], 0
    while i < len(s):
        c = s[i]
        if c == "\\":
            if i + 1 == len(s):
                raise ValueError(f'invalid escape sequence in {code} value "\\": EOF during escaped character')
            c = s[i + 1]
            if c == "x":
                digits = s[i + 2 : i + 4]
                if len(digits) < 2:
                    raise ValueError(f'invalid escape sequence in {code} value "\\x{digits}": EOF during hex encoded character')
                if not re.fullmatch("[0-9a-fA-F]{2}", digits):
                    raise ValueError(f'invalid escape sequence in {code} value "\\x{digits}"')
                n = int(digits, 16)
                out.append("\\x00" if n == 0 and code == "CSTR" else chr(n))
                i += 4
                continue
            if c not in 'nr\\"':
                raise ValueError(f"invalid escape sequence in {code} value: \\{c}")
            out.append({"n": "\n", "r": "\r"}.get(c, c))
            i += 2
            continue
        if c == '"' or ord(c) < 0x20 or ord(c) == 0x7F:
            raise ValueError(f"character {c!r} must be escaped in {code} value")
        out.append(c)
        i += 1
    return "".join(out)


def _undelimited(code: str, s: str) -> str:
    if len(s) < 2 or s[0] != '"' or s[-1] != '"':
        raise ValueError(f"{code} value must be delimited by '\"'")
    return s[1:-1]


def _ip(s: str) -> bytes:
    if s[:2] in ("0x", "0X"):
        if len(s) < 10 or (len(s) - 2) % 8:
            raise _invalid("IP32", s)
        return bytes.fromhex(s[2:])
    parts = s.split(".")
    if len(parts) != 4 or not all(p.isdigit() and int(p) < 256 for p in parts):
        raise _invalid("IP32", s)
    return bytes(map(int, parts))


def encode_text(code: str, s: str) -> bytes:
    """The data of a value written as in a text document."""
    t = TYPES.get(code)
    if t is None:
        raise ValueError(f"unknown type {code}")
    match t.family:
        case "bool":
            known = {"false": 0, "0": 0, "+0": 0, "-0": 0, "true": 1, "1": 1, "+1": 1}
            return known[s].to_bytes(4, "big") if s in known else _raise(_invalid(code, s))
        case "unsigned" | "signed" | "enum":
            try:
                n = integer(s)
            except ValueError:
                raise _invalid(code, s) from None
            return _packed(code, n, t.width, t.family != "unsigned")
        case "float":
            try:
                return encode_value(code, float(s.replace("_", "x")))
            except (ValueError, OverflowError):
                raise _invalid(code, s) from None
        case "unsigned fixed" | "signed fixed":
            return _scaled(code, s)
        case "unsigned fraction" | "signed fraction":
            return _fraction(code, s)
        case "four chars":
            try:
                return raw_of(s[1:-1] if len(s) == 6 and s[0] == s[-1] and s[0] in "'\"" else f"0x{s}" if len(s) == 8 else s)
            except ValueError:
                raise _invalid(code, s) from None
        case "uuid":
            bare = s[1:-1] if s[:1] == s[-1:] and s[:1] in ("'", '"') else s
            if not re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", bare):
                raise _invalid(code, s)
            return bytes.fromhex(bare.replace("-", ""))
        case "ip":
            return _ip(s)
        case "ip text":
            bare = _undelimited(code, s)
            if not bare or not re.fullmatch(r"[0-9a-fA-F.:]+", bare):
                raise _invalid(code, s)
            return bare.encode() + b"\0"
        case "c string":
            return unescape(code, _undelimited(code, s)).encode() + b"\0"
        case "utf-32 string":
            return unescape(code, _undelimited(code, s)).encode("utf-32-be", "surrogatepass")
        case "bytes":
            if s and not re.fullmatch(r"0[xX]([0-9a-fA-F]{2})*", s):
                raise _invalid(code, s)
            return bytes.fromhex(s[2:])
        case "null":
            return b"" if not s else _raise(_invalid(code, s))
    return b""


def encode_value(code: str, v: Any) -> bytes:
    """The data of a host value; None gives the type's zero."""
    t = TYPES.get(code)
    if t is None:
        raise ValueError(f"unknown type {code}")
    if v is None:
        if t.family in ("unsigned fraction", "signed fraction"):
            return pack_fraction(code, 0, 1, t.width // 2, False)
        return bytes(t.width or {"c string": 1, "ip text": 1, "ip": 4}.get(t.family, 0))
    if isinstance(v, bytes | bytearray):
        return bytes(v)
    match t.family, v:
        case "bool", bool() | int():
            return int(v).to_bytes(4, "big") if v in (0, 1) else _raise(_range_error(code, v))
        case "unsigned" | "signed" | "enum", int():
            return _packed(code, v, t.width, t.family != "unsigned")
        case "float", int() | float():
            if not math.isfinite(v):
                raise _range_error(code, v)
            try:
                return struct.pack(">f" if t.width == 4 else ">d", v)
            except OverflowError:
                raise _range_error(code, v) from None
        case "unsigned fixed" | "signed fixed", int() | float():
            return _packed(code, math.trunc(v * (1 << 4 * t.width)), t.width, t.family == "signed fixed")
        case "unsigned fraction" | "signed fraction", (int() as num, int() as den):
            return pack_fraction(code, num, den, t.width // 2, code[0] == "S")
        case "c string", str():
            return v.encode() + b"\0" if "\0" not in v else _raise(_invalid(code, v))
        case "utf-32 string", str():
            return v.encode("utf-32-be")
        case "ip text", str():
            return encode_text(code, f'"{v}"')
        case "ip", int():
            return _packed(code, v, 4 if v < 1 << 32 else 8, False)
        case "four chars", int():
            return _packed(code, v, 4, False)
        case _, str():
            return encode_text(code, v)
    raise ValueError(f"cannot use type '{type(v).__name__}' for type '{code}'")
