import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanwood.functions import codec
from spanwood.types import TYPES, name_of, raw_of

CASES = [
    ("UI01", "00000001", "1"),
    ("UI08", "ff", "255"),
    ("UI16", "0102", "258"),
    ("UI32", "ffffffff", "4294967295"),
    ("UI64", "ffffffffffffffff", "18446744073709551615"),
    ("SI08", "80", "-128"),
    ("SI16", "fffe", "-2"),
    ("SI32", "80000000", "-2147483648"),
    ("SI64", "fffffffffffffff6", "-10"),
    ("FP32", "3fc00000", "1.50000000E+00"),
    ("FP64", "3fb999999999999a", "1.00000000000000006E-01"),
    ("UF32", "00018000", "1.5000"),
    ("SF32", "fffe8000", "-1.5000"),
    ("UF64", "0000000180000000", "1.500000000"),
    ("UF64", "00000001ffffffff", "1.1000000000"),
    ("SF64", "fffffffe80000000", "-1.500000000"),
    ("UR32", "00010002", "1/2"),
    ("SR64", "ffffffff00000002", "-1/2"),
    ("FC32", "61626364", "'abcd'"),
    ("FC32", "00626364", "0x00626364"),
    ("ENUM", "ffffffff", "-1"),
    ("UUID", "00112233445566778899aabbccddeeff", "00112233-4455-6677-8899-AABBCCDDEEFF"),
    ("IP32", "0a000001", "10.0.0.1"),
    ("IP32", "0a0000010a000002", "0x0A0000010A000002"),
    ("IPAD", "3a3a3100", '"::1"'),
    ("CSTR", "61220a5c01ff00", '"a\\"\\n\\\\\\x01\\xFF"'),
    ("USTR", "000000e90000000a", '"é\\n"'),
    ("DATA", "00ff", "0x00FF"),
    ("DATA", "", ""),
    ("NULL", "", ""),
]


@pytest.mark.parametrize("code,data,text", CASES)
def test_text_of_data(code, data, text):
    assert codec.decode(code, bytes.fromhex(data)).text == text


@pytest.mark.parametrize("code,data,text", [c for c in CASES if c[:2] not in {("CSTR", "61220a5c01ff00"), ("UF64", "00000001ffffffff")}])
def test_data_of_text(code, data, text):
    want = bytes.fromhex(data)
    if code == "SR64":
        assert codec.encode_text(code, text) == want
    assert codec.encode_text(code, text) == want


def test_lone_bytes_become_code_points():
    assert codec.encode_text("CSTR", '"\\xFF"') == b"\xc3\xbf\0"
    assert codec.encode_text("CSTR", '"\\x00"') == b"\\x00\0"


def test_negative_denominator_lowers_the_numerator():
    assert codec.encode_text("SR64", "1/-1").hex() == "00000000ffffffff"


@pytest.mark.parametrize(
    "code,text,message",
    [
        ("UI08", "256", "value exceeds range of type UI08: 256"),
        ("SI08", "-129", "value exceeds range"),
        ("UI32", "abc", 'invalid string value for type UI32: "abc"'),
        ("UR32", "1/0", "forbids zero in denominator"),
        ("CSTR", "abc", "CSTR value must be delimited"),
        ("CSTR", '"a\\q"', "invalid escape sequence in CSTR value"),
        ("CSTR", '"a\\x0"', "EOF during hex encoded character"),
        ("IP32", "1.2.3", "invalid string value"),
        ("UUID", "1234", "invalid string value"),
        ("NULL", "x", "invalid string value"),
        ("IPAD", '""', "invalid string value"),
        ("XXXX", "1", "unknown type"),
    ],
)
def test_bad_text(code, text, message):
    with pytest.raises(ValueError, match=message.replace("(", "\\(")):
        codec.encode_text(code, text)


@pytest.mark.parametrize("code,data", [("UI32", "00"), ("UI01", "00000002"), ("CSTR", "61"), ("CSTR", "610061"), ("USTR", "00"), ("IPAD", ""), ("UUID", "00")])
def test_bad_data(code, data):
    with pytest.raises(ValueError):
        codec.decode(code, bytes.fromhex(data))


def test_integers_with_bases():
    assert [codec.integer(s) for s in ("010", "0x1F", "-0b11", "0o17", "1_000", "0")] == [8, 31, -3, 15, 1000, 0]
    for bad in ("08", "1__0", "", "x"):
        with pytest.raises(ValueError):
            codec.integer(bad)


def test_zero_values_have_the_types_width():
    for t in TYPES.values():
        if t.width:
            assert len(codec.encode_value(t.code, None)) == t.width


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_characters="\0"), max_size=40))
def test_strings_survive(s):
    for code in ("CSTR", "USTR"):
        v = codec.decode(code, codec.encode_value(code, s))
        assert v.s == s
        assert codec.encode_text(code, v.text) == codec.encode_value(code, s)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=4, max_size=4))
def test_names_survive(raw):
    assert raw_of(name_of(raw)) == raw
