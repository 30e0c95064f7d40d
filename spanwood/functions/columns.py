"""Decoders and encoders as Spark columns, and Arrow functions for what Spark's own functions can't express.

Integers, fixed-point numbers, floats' bits, fractions, addresses, UUIDs, UTF-8 and UTF-32 strings stay within Spark's own
functions; the exact decimal form of floats and damaged UTF-8 use Arrow batches.
"""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..types import TYPES
from . import codec


def _whole(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def unsigned(data: Column) -> Column:
    """Up to eight big-endian bytes as decimal(20,0)."""
    return F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")


def signed(data: Column, width: int) -> Column:
    """A two's complement number of that many bytes as bigint."""
    u = unsigned(data).cast("decimal(38,0)")
    return F.when(u >= _whole(2 ** (8 * width - 1)), u - _whole(2 ** (8 * width))).otherwise(u).cast("bigint")


def float_of(data: Column, width: int) -> Column:
    """An IEEE number of 4 or 8 big-endian bytes, from its sign, exponent and fraction."""
    fraction_bits, bias = (23, 127) if width == 4 else (52, 1023)
    n = signed(data, width)
    exponent = F.shiftright(n, fraction_bits).bitwiseAND(F.lit(2 * bias + 1))
    fraction = n.bitwiseAND(F.lit((1 << fraction_bits) - 1).cast("bigint")).cast("double")
    sign = F.when(n < 0, -1.0).otherwise(1.0)
    normal = (1 + fraction / float(1 << fraction_bits)) * F.pow(F.lit(2.0), (exponent - bias).cast("double"))
    small = fraction * F.lit(2.0 ** (1 - bias - fraction_bits))
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(exponent == 0, small).when(exponent == 2 * bias + 1, special).otherwise(normal)


def fixed(data: Column, width: int, is_signed: bool) -> Column:
    n = signed(data, width) if is_signed else unsigned(data)
    return n.cast("double") / float(1 << 4 * width)


def fixed_text(data: Column, width: int, is_signed: bool) -> Column:
    """Four or nine decimals; half to even, and in the wide form without a carry into the whole number."""
    if width == 4:
        n = (signed(data, 4) if is_signed else unsigned(data)).cast("decimal(20,0)")
        return F.bround(n.cast("decimal(21,0)") * F.lit("0.0000152587890625").cast("decimal(16,16)"), 4).cast("decimal(20,4)").cast("string")
    n = signed(data, 8).cast("decimal(20,0)") if is_signed else unsigned(data)
    size = F.abs(n).cast("decimal(38,0)")
    unit = _whole(1 << 32)
    part = F.pmod(size, unit)
    whole = ((size - part) / unit).cast("decimal(20,0)").cast("string")
    digits = F.format_string("%09d", F.rint(part.cast("double") / 4294967296.0 * 1e9).cast("bigint"))
    return F.concat(F.when(n < 0, "-").otherwise(""), whole, F.lit("."), digits)


def fraction(data: Column, width: int, is_signed: bool) -> Column:
    """The two numbers, bigint or decimal(20,0)."""
    halves = [F.substring(data, 1, width // 2), F.substring(data, width // 2 + 1, width // 2)]
    return F.array(*(signed(h, width // 2) if is_signed else unsigned(h) for h in halves))


def fraction_text(data: Column, width: int, is_signed: bool) -> Column:
    return F.array_join(F.transform(fraction(data, width, is_signed), lambda x: x.cast("string")), "/")


def address(data: Column) -> Column:
    """Dotted for four bytes, hexadecimal for several addresses."""
    parts = [F.conv(F.hex(F.substring(data, i, 1)), 16, 10) for i in range(1, 5)]
    return F.when(F.octet_length(data) == 4, F.concat_ws(".", *parts)).otherwise(F.concat(F.lit("0x"), F.hex(data)))


def uuid(data: Column) -> Column:
    return F.regexp_replace(F.hex(data), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def bytes_text(data: Column) -> Column:
    return F.when(F.octet_length(data) == 0, "").otherwise(F.concat(F.lit("0x"), F.hex(data)))


def four_chars(data: Column) -> Column:
    shown = F.decode(data, "ISO-8859-1")
    return F.when(shown.rlike(r"""^[!$-&(-~][!#-&(-~]{3}$"""), shown).otherwise(F.concat(F.lit("0x"), F.hex(data)))


def big_endian(n: Column, width: int) -> Column:
    """An integer's bytes, two's complement; an error outside the range."""
    whole = n.cast("decimal(38,0)")
    wrapped = F.pmod(whole, _whole(1 << 8 * width))
    fits = (whole >= _whole(-(1 << 8 * width - 1))) & (whole < _whole(1 << 8 * width))
    return F.when(fits, F.unhex(F.lpad(F.conv(wrapped.cast("decimal(20,0)").cast("string"), 10, 16), 2 * width, "0"))).otherwise(
        F.raise_error(F.concat(F.lit(f"value exceeds range of {8 * width} bits: "), whole.cast("string")))
    )


def c_string(s: Column) -> Column:
    return F.concat(F.encode(s, "UTF-8"), F.lit(b"\0"))


def c_string_value(data: Column) -> Column:
    """The string of a null-terminated value, if it is UTF-8; else by the Arrow decoder."""
    return F.decode(F.substring(data, F.lit(1), F.octet_length(data) - 1), "UTF-8")


@pandas_udf(T.BinaryType())
def encode_text(code: pd.Series, text: pd.Series) -> pd.Series:
    """Data of values written as in a text document."""
    return pd.Series([None if s is None else codec.encode_text(c, s) for c, s in zip(code, text)])


@pandas_udf(T.StringType())
def text_of(code: pd.Series, data: pd.Series) -> pd.Series:
    """The text form of any type's data."""
    return pd.Series([None if d is None else codec.decode(c, bytes(d)).text for c, d in zip(code, data)])


@pandas_udf(T.StringType())
def float_text(code: pd.Series, value: pd.Series) -> pd.Series:
    """Floats in the text form of their type, all digits exact."""
    return pd.Series([None if pd.isna(v) else codec.decode(c, codec.encode_value(c, float(v))).text for c, v in zip(code, value)])


@pandas_udf(T.BinaryType())
def float_data(code: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else codec.encode_value(c, float(v)) for c, v in zip(code, value)])


def wide_string(s: Column) -> Column:
    return F.encode(s, "UTF-32")  # big-endian, without a mark


_WIDE = "^(?:0000(?:[0-9A-CEF][0-9A-F]{3}|D[0-7][0-9A-F]{2})|00(?:0[1-9A-F]|10)[0-9A-F]{4})*+$"  # code points that are characters


def wide_string_value(data: Column) -> Column:
    """The string of UTF-32 data; what is no character shows as its number. Row by row, so long strings in many rows need no memory together."""
    mark = F.lit(b"\0\0\xfe\xff")  # is dropped, and keeps another one at the start as a character
    decoded = F.decode(F.concat(mark, data), "UTF-32")
    bits = F.hex(data)

    def shown(k: Column) -> Column:
        own = F.substring(data, k * 4 + 1, F.lit(4))
        return F.when(F.hex(own).rlike(_WIDE), F.decode(F.concat(mark, own), "UTF-32")).otherwise(F.concat(F.lit("\\x"), F.ltrim(F.hex(own), F.lit("0"))))

    each = F.array_join(F.transform(F.sequence(F.lit(0), (F.octet_length(data) / 4).cast("int") - 1), shown), "")
    size = F.octet_length(data)
    wrong = F.raise_error(F.concat(F.lit("invalid byte count for type USTR: want a multiple of 4, got "), size.cast("string"))).cast("string")
    return F.when(size % 4 != 0, wrong).when(bits.rlike(_WIDE), decoded).otherwise(each)


def escaped(s: Column) -> Column:
    """A string in quotes, with escapes for quotes, backslashes, line breaks and control characters."""
    out = s
    for plain, named in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(plain), F.lit(named))
    rest = out
    for c in (*range(10), 11, 12, *range(14, 32), 127):
        rest = F.replace(rest, F.lit(chr(c)), F.lit(f"\\x{c:02X}"))
    return F.concat(F.lit('"'), F.when(s.rlike(r"[\x00-\x09\x0B\x0C\x0E-\x1F\x7F]"), rest).otherwise(out), F.lit('"'))


def value(code: str, data: Column) -> Column:
    """The value of a known type's data: decimal, bigint, double or string."""
    t = TYPES[code]
    is_signed = code[0] == "S"
    match t.family:
        case "bool" | "unsigned":
            return unsigned(data)
        case "signed":
            return signed(data, t.width)
        case "float":
            return float_of(data, t.width)
        case "unsigned fixed" | "signed fixed":
            return fixed(data, t.width, is_signed)
        case "unsigned fraction" | "signed fraction":
            return fraction_text(data, t.width, is_signed)
        case "four chars":
            return four_chars(data)
        case "enum":
            return signed(data, 4).cast("string")
        case "uuid":
            return uuid(data)
        case "ip":
            return address(data)
        case "ip text" | "c string":
            return c_string_value(data)
        case "utf-32 string":
            return wide_string_value(data)
        case "bytes":
            return bytes_text(data)
    return F.lit("")
