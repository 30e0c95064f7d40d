"""Values of path expressions as typed columns, and the coercions between their kinds.

Kinds: u unsigned and i signed 64-bit integers, f floats, s strings, b booleans. A value has a column for each kind that
it may have and, where these are several, a column that tells which; an operation makes a CASE over the pairs of kinds
that can meet, and one expression where both are known.
"""

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.codec import integer

BIG = 1 << 64


def dec(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


class Val:
    def __init__(self, columns: dict[str, Column], tag: Column | None = None):
        self.columns, self.tag = columns, tag

    def is_(self, kind: str) -> Column | None:
        """The condition that the value has this kind; None where it always has."""
        return None if len(self.columns) == 1 else self.tag == kind

    def pick(self, make: Callable[[str, Column], Column]) -> Column:
        """CASE over the kinds."""
        items = list(self.columns.items())
        out = make(*items[-1])
        for k, c in reversed(items[:-1]):
            out = F.when(self.tag == k, make(k, c)).otherwise(out)
        return out


def both(l: Val, r: Val, make: Callable[[str, Column, str, Column], Column]) -> Column:
    return l.pick(lambda lk, lc: r.pick(lambda rk, rc: make(lk, lc, rk, rc)))


def to_int(c: Column) -> Column:
    """An unsigned number's 64 bits as signed."""
    d = c.cast("decimal(38,0)")
    return F.when(d >= dec(1 << 63), d - dec(BIG)).otherwise(d).cast("bigint")


def double(kind: str, c: Column) -> Column:
    return c if kind == "f" else c.cast("double")


# ---- strings as numbers


def text(value: str) -> Column:
    """A string literal that keeps its Python value, so that what it is as a number is settled while the plan is made."""
    out = F.lit(value)
    out.__dict__["plain"] = value
    return out


def _settled(s: Column, kind: str, parse: Callable[[str], object]) -> Column | None:
    if "plain" not in s.__dict__:
        return None
    value = parse(s.__dict__["plain"])
    return F.lit(None if value is None else str(value)).cast(kind)


_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"
_BASED = r"^[+-]?(0[xX](_?[0-9a-fA-F])+|0[bB](_?[01])+|0[oO]?(_?[0-7])+|0|[1-9](_?[0-9])*)$"


def float_of(s: Column) -> Column:
    """The number that a string writes, or null."""
    known = _settled(s, "double", lambda x: x if re.match(_FLOAT, x) else float(x) if re.match(_SPECIAL, x) else None)
    if known is not None:
        return known
    special = F.when(F.lower(s).contains("nan"), F.lit(float("nan"))).when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(s.rlike(_FLOAT), s.try_cast("double")).when(s.rlike(_SPECIAL), special)


def whole_of(s: Column, least: int, most: int, based: bool = True) -> Column:
    """The integer that a string writes, with base prefixes if based, as decimal; or null."""

    def parse(x: str):
        if not re.match(_BASED if based else r"^[0-9]+$", x) or least == 0 and x[0] in "+-":
            return None
        n = integer(x) if based else int(x)
        return n if least <= n <= most else None

    known = _settled(s, "decimal(38,0)", parse)
    if known is not None:
        return known
    def part(pattern: str, base: int) -> Column:
        digits = F.nullif(F.regexp_extract(s, pattern, 2), F.lit(""))
        return digits.try_cast("decimal(38,0)") if base == 10 else F.conv(digits, base, 10).try_cast("decimal(38,0)")

    sign = "()" if least == 0 else "([+-]?)"
    if not based:
        n = part("^()([0-9]{1,38})$", 10)
    else:  # an underscore between digits is rare enough to be left to those who write it as a literal
        n = F.coalesce(part(f"^{sign}(0|[1-9][0-9]{{0,37}})$", 10), part(f"^{sign}0[xX]0*([0-9a-fA-F]{{1,16}})$", 16), part(f"^{sign}0[oO]?0*([0-7]{{1,21}})$", 8), part(f"^{sign}0[bB]0*([01]{{1,64}})$", 2))
    if least < 0:
        n = F.when(s.startswith("-"), -n).otherwise(n)
    return F.when(n.between(dec(least), dec(most)), n)


def unsigned_of(s: Column, based: bool = True) -> Column:
    return whole_of(s, 0, BIG - 1, based)


def signed_of(s: Column) -> Column:
    return whole_of(s, -(1 << 63), (1 << 63) - 1)


def shown_float(c: Column) -> Column:
    """The shortest form of a float, with an exponent from 21 digits on the left or beyond four zeros on the right."""
    text = c.cast("string")
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.17f", c), "0+$", ""), r"\.$", "")
    short = F.regexp_replace(text, r"\.0$", "")
    m = F.regexp_extract(text, r"^(-?[0-9.]+)E", 1)
    e = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    mantissa = F.regexp_replace(m, r"\.0$", "")
    with_e = F.concat(mantissa, F.lit("E"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    small = F.abs(c) < 1e-3
    named = F.when(F.isnan(c), "NaN").when(c == float("inf"), "+Inf").when(c == float("-inf"), "-Inf")
    return F.coalesce(named, F.when(text.contains("E") & (e < 21) & (e > 0), F.regexp_replace(F.format_string("%.0f", c), r"\.$", "")).when(text.contains("E") & small & (F.abs(c) >= 1e-4), plain).when(text.contains("E"), with_e).otherwise(short))


# ---- comparisons


def _same_float(a: Column, b: Column) -> Column:
    return (a == b) & ~F.isnan(a)  # unlike Spark's, a NaN equals nothing


def equal(l: Val, r: Val) -> Column:
    no = F.lit(False)

    def make(lk, lc, rk, rc):
        match lk + rk:
            case "ff" | "fu" | "fi" | "uf" | "if":
                return _same_float(double(lk, lc), double(rk, rc))
            case "fs":
                return F.coalesce(_same_float(lc, float_of(rc)), no)
            case "uu" | "ii" | "bb":
                return lc == rc
            case "ui":
                return to_int(lc) == rc
            case "iu":
                return lc == to_int(rc)
            case "us":
                return F.coalesce(lc == unsigned_of(rc), no)
            case "is":
                return F.coalesce(_same_float(lc.cast("double"), float_of(rc)), lc == to_int(unsigned_of(rc, False)), lc.cast("decimal(38,0)") == signed_of(rc), no)
            case "sf":
                return lc == shown_float(rc)
            case "su":
                return lc == to_int(rc).cast("string")
            case "si":
                return lc == rc.cast("string")
            case "ss":
                return F.lower(lc) == F.lower(rc)
            case "bu" | "bi":
                return (rc != 0) == lc
            case "ub" | "ib":
                return F.raise_error(F.lit("a number can't be compared with a boolean")).cast("boolean")
        return no

    return both(l, r, make)


def ordered(l: Val, r: Val, less: bool, strict_strings: bool = False) -> Column:
    """l < r or l > r. Two strings that aren't numbers are compared as > either way, unless strict_strings."""
    no = F.lit(False)
    test = (lambda a, b: a < b) if less else (lambda a, b: a > b)

    def floats(a, b):
        return test(a, b) & ~F.isnan(a) & ~F.isnan(b)

    def make(lk, lc, rk, rc):
        match lk + rk:
            case "ff" | "fu" | "fi" | "uf" | "if":
                return floats(double(lk, lc), double(rk, rc))
            case "uu" | "ii":
                return test(lc, rc)
            case "ui":
                return test(to_int(lc), rc)
            case "iu":
                return test(lc, to_int(rc))
            case "us" | "is":
                n = lc.cast("decimal(38,0)")
                return F.coalesce(floats(lc.cast("double"), float_of(rc)), test(n, unsigned_of(rc, False)), test(n, signed_of(rc)), no)
            case "sf" | "su" | "si" | "ss":
                known = [("f", float_of(lc)), ("u", unsigned_of(lc).cast("decimal(20,0)")), ("i", signed_of(lc).cast("bigint"))]
                text_ = no if rk != "s" else test(lc, rc) if strict_strings else lc > rc
                if rk == "s":  # a string that writes a number meets another string as that number
                    return F.when(known[0][1].isNotNull(), no).when(known[1][1].isNotNull(), make("u", known[1][1], rk, rc)).when(known[2][1].isNotNull(), make("i", known[2][1], rk, rc)).otherwise(text_)
                return F.coalesce(*(make(k, c, rk, rc) for k, c in known), text_)
        return no

    return both(l, r, make)


# ---- arithmetic


def _wrap_signed(d: Column) -> Column:
    return (F.pmod(d + dec(1 << 63), dec(BIG)) - dec(1 << 63)).cast("bigint")


def _wrap_unsigned(d: Column) -> Column:
    return F.pmod(d, dec(BIG)).cast("decimal(20,0)")


def _times(a: Column, b: Column) -> Column:
    """The product of two numbers under 2**64, modulo 2**64: 40 digits would be too many at once."""
    a, b = a.cast("decimal(20,0)"), b.cast("decimal(20,0)")
    half = F.lit(1 << 32).cast("decimal(10,0)")
    low = F.pmod(a, half).cast("decimal(10,0)")
    high = ((a - low) / half).cast("decimal(10,0)")
    top = F.pmod((high * b).cast("decimal(38,0)"), half.cast("decimal(38,0)")) * dec(1 << 32)
    return F.pmod(F.pmod(top.cast("decimal(38,0)"), dec(BIG)) + F.pmod((low * b).cast("decimal(38,0)"), dec(BIG)), dec(BIG)).cast("decimal(20,0)")


def _unsigned_bits(c: Column) -> Column:
    return F.pmod(c.cast("decimal(38,0)"), dec(BIG)).cast("decimal(20,0)")


def _divide(a: Column, b: Column) -> Column:
    zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, 1.0).otherwise(b))




def arithmetic(op: str, l: Val, r: Val) -> Val:
    """The value of l op r; kinds as integer and float rules give them."""
    found: dict[str, list[tuple[Column, Column]]] = {}
    always = F.lit(True)
    for lk, lc in l.columns.items():
        for rk, rc in r.columns.items():
            when = always
            for cond in (l.is_(lk), r.is_(rk)):
                if cond is not None:
                    when = when & cond
            for kind, column, also in _pair(op, lk, lc, rk, rc):
                found.setdefault(kind, []).append((when if also is None else when & also, column))
    columns, tag = {}, None
    for kind, cases in found.items():
        out = None
        for when, column in cases:
            out = F.when(when, column) if out is None else out.when(when, column)
        columns[kind] = cases[0][1] if len(found) == 1 and len(cases) == 1 else out
    if len(found) > 1:
        for kind, cases in found.items():
            for when, _ in cases:
                tag = F.when(when, kind) if tag is None else tag.when(when, kind)
    return Val(columns, tag)


def _pair(op: str, lk: str, lc: Column, rk: str, rc: Column):
    """(kind, column, further condition) of one pair of kinds."""
    if lk in "sb" or rk in "sb":
        return [("i", F.raise_error(F.lit("invalid predicate: expected numeric value")).cast("bigint"), None)]
    floats = "f" in (lk, rk)
    a, b = double(lk, lc), double(rk, rc)
    if op == "div":
        return [("f", _divide(a, b), None)]
    if op == "idiv" and (floats or lk + rk != "uu"):
        x, y = (c.cast("bigint") if k != "u" else to_int(c) for k, c in ((lk, lc), (rk, rc)))
        y = F.when(y == 0, F.raise_error(F.lit("integer divide by zero")).cast("bigint")).otherwise(y)
        return [("i", F.call_function("div", x, y), None)]
    if op == "mod" and floats:
        return [("f", F.when((b == 0) | F.isnan(b), F.lit(float("nan"))).otherwise(a % F.when(b == 0, 1.0).otherwise(b)), None)]
    if floats:
        return [("f", a + b if op == "+" else a - b if op == "-" else a * b, None)]
    if lk + rk == "uu":
        x, y = lc.cast("decimal(38,0)"), rc.cast("decimal(38,0)")
        if op in ("idiv", "mod"):
            y = F.when(y == 0, F.raise_error(F.lit("integer divide by zero")).cast("decimal(38,0)")).otherwise(y)
            rest = (x % y).cast("decimal(38,0)")
            return [("u", (rest if op == "mod" else ((x - rest) / y)).cast("decimal(20,0)"), None)]
        return [("u", _times(lc, rc) if op == "*" else _wrap_unsigned(x + y if op == "+" else x - y), None)]
    x, y = (to_int(c) if k == "u" else c for k, c in ((lk, lc), (rk, rc)))
    if op == "mod":
        y = F.when(y == 0, F.raise_error(F.lit("integer divide by zero")).cast("bigint")).otherwise(y)
        out = x % y
    else:
        wide = {"+": lambda p, q: p + q, "-": lambda p, q: p - q, "*": lambda p, q: p * q}[op]
        quick = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
        out = F.coalesce(quick(x, y), _wrap_signed(wide(x.cast("decimal(19,0)"), y.cast("decimal(19,0)")).cast("decimal(38,0)")))
    if lk + rk == "iu":  # a negative left side stays signed
        return [("i", out, lc < 0), ("u", _unsigned_bits(out), lc >= 0)]
    return [("i", out, None)]


def at_position(value: Val, position: Column) -> Column:
    """A numeric predicate: the value equals the position."""

    def make(kind, c):
        match kind:
            case "b":
                return c
            case "f":
                return _same_float(c, position.cast("double"))
            case "u":
                return c == position
            case "i":
                return c == position
        return F.raise_error(F.lit("result has unknown type string")).cast("boolean")

    return value.pick(make)
