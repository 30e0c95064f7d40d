"""Operator 5: media columns by signature sniffing.

An Aho-Corasick automaton of all formats' magic bytes runs once over each value; at every place that it reports,
that format's validator checks structure and lengths. What is confirmed at byte 0 and fills the value corrects the
declared type; what is confirmed elsewhere is embedded media (an inner file of one that is already listed isn't listed
again), whose bytes `carve_media` gives.

`store_as_wav` makes the media column that the registered query sniffs: a text's UTF-8 bytes, padded with byte 32
to a positive multiple of UNIT, as unsigned 8-bit samples of a mono WAV file.

Defined cases: a null value has the type null, no media and a null corrected type; an empty one has the type
`application/octet-stream`; a value of any length is scanned whole; a null text is stored as an empty one; equal
values have equal results; columns beside the media's stay, but those named as the new ones are replaced.
"""

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship

UNIT = 192
RATE = 16000
UNKNOWN = "application/octet-stream"


def _wav(d: bytes, at: int) -> int:
    """Length of the file at `at`, 0 if there is none. So for all validators."""
    if d[at + 8 : at + 12] != b"WAVE" or at + 12 > len(d):
        return 0
    size = struct.unpack_from("<I", d, at + 4)[0] + 8
    if size < 20 or at + size > len(d):
        return 0
    p, found = at + 12, set()
    while p + 8 <= at + size:
        kind, n = d[p : p + 4], struct.unpack_from("<I", d, p + 4)[0]
        if p + 8 + n > at + size:
            return 0
        found.add(kind)
        p += 8 + n + (n & 1)
    return size if {b"fmt ", b"data"} <= found else 0


def _png(d: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(d):
        n, kind = struct.unpack_from(">I", d, p)[0], d[p + 4 : p + 8]
        if first and (kind != b"IHDR" or n != 13) or p + 12 + n > len(d):
            return 0
        if zlib.crc32(d[p + 4 : p + 8 + n]) != struct.unpack_from(">I", d, p + 8 + n)[0]:
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def _gif(d: bytes, at: int) -> int:
    if at + 13 > len(d):
        return 0
    p = at + 13 + (3 << ((d[at + 10] & 7) + 1) if d[at + 10] & 0x80 else 0)
    while p < len(d):
        if d[p] == 0x3B:
            return p + 1 - at
        if d[p] == 0x21:
            p += 2
        elif d[p] == 0x2C and p + 10 < len(d):
            p += 10 + (3 << ((d[p + 9] & 7) + 1) if d[p + 9] & 0x80 else 0) + 1
        else:
            return 0
        while p < len(d) and d[p]:
            p += 1 + d[p]
        p += 1
    return 0


def _jpeg(d: bytes, at: int) -> int:
    p, frame = at + 2, False
    while p + 4 <= len(d) and d[p] == 0xFF:
        kind, n = d[p + 1], struct.unpack_from(">H", d, p + 2)[0]
        if n < 2:
            return 0
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if kind == 0xDA:
            if not frame:
                return 0
            while (p := d.find(b"\xff", p)) >= 0 and p + 1 < len(d):
                if d[p + 1] == 0xD9:
                    return p + 2 - at
                if d[p + 1] != 0 and not 0xD0 <= d[p + 1] <= 0xD7:
                    break
                p += 2
            if p < 0:
                return 0
    return 0


def _bmp(d: bytes, at: int) -> int:
    if at + 54 > len(d):
        return 0
    size, zero, pixels, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", d, at + 2)
    rows = (abs(width) * bits + 31) // 32 * 4 * abs(height)
    return size if not zero and header in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and at + size <= len(d) and pixels >= 14 + header and pixels + rows <= size and width > 0 and height else 0


@lru_cache(2)
def _zip_ends(d: bytes) -> dict[int, int]:
    """Where archives end, by where they start: each end record names the start itself."""
    out, p = {}, d.find(b"PK\x05\x06")
    while 0 <= p <= len(d) - 22:
        n, where, note = struct.unpack_from("<IIH", d, p + 12)
        at = p - n - where
        if at >= 0 and p + 22 + note <= len(d) and (n == 0 or d[at + where : at + where + 4] == b"PK\x01\x02"):
            out.setdefault(at, p + 22 + note)
        p = d.find(b"PK\x05\x06", p + 4)
    return out


def _zip(d: bytes, at: int) -> int:
    return _zip_ends(d).get(at, at) - at


def _gzip(d: bytes, at: int) -> int:
    if at + 18 > len(d) or d[at + 3] & 0xE0:
        return 0
    z = zlib.decompressobj(31)
    left = d[at:]
    try:
        while left and not z.eof:
            z.decompress(left, 1 << 20)
            left = z.unconsumed_tail
    except zlib.error:
        return 0
    return len(d) - at - len(z.unused_data) if z.eof else 0


@lru_cache(2)
def _pdf_end(d: bytes) -> tuple[int, int]:
    """Where the last end mark stands, and the last cross-reference before it."""
    end = d.rfind(b"%%EOF")
    return end, d.rfind(b"startxref", 0, max(0, end))


def _pdf(d: bytes, at: int) -> int:
    end, table = _pdf_end(d)
    return end + 5 - at if end > at and table > at and d[at + 5 : at + 8].replace(b".", b"").isdigit() else 0


def _flac(d: bytes, at: int) -> int:
    p = at + 4
    while p + 4 <= len(d):
        last, n = d[p] >> 7, int.from_bytes(d[p + 1 : p + 4], "big")
        if p == at + 4 and (d[p] & 127 or n != 34) or p + 4 + n > len(d):
            return 0
        p += 4 + n
        if last:
            return len(d) - at if d[p : p + 2] in (b"\xff\xf8", b"\xff\xf9") else 0
    return 0


#: Magic bytes, type and validator of each format.
FORMATS = [
    (b"RIFF", "audio/wav", _wav),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"%PDF-", "application/pdf", _pdf),
    (b"fLaC", "audio/flac", _flac),
]


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic, kind, valid in FORMATS:
        out.add_word(magic.decode("latin-1"), (len(magic), kind, valid))
    out.make_automaton()
    return out


def sniff(data: bytes, magic: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, start, length) of all confirmed media, in order, without those inside another but the outermost's first level."""
    found, top_end, inner_end = [], 0, 0
    for last, (n, kind, valid) in magic.iter(data.decode("latin-1")):
        at = last + 1 - n
        if at and at < inner_end:
            continue
        if size := valid(data, at):
            found.append((kind, at, size))
            if at == 0 and not top_end:
                top_end = size
            else:
                inner_end = at + size
    return found


def store_as_wav(text: bytes) -> bytes:
    payload = text + b" " * (-len(text) % UNIT or UNIT * (not text))
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def wav_samples(media: bytes) -> bytes:
    p = 12
    while media[p : p + 4] != b"data":
        n = struct.unpack_from("<I", media, p + 4)[0]
        p += 8 + n + (n & 1)
    return media[p + 8 : p + 8 + struct.unpack_from("<I", media, p + 4)[0]]


FOUND = "array<struct<kind:string,start:long,length:long>>"


def _mapped(df: DataFrame, expr, name: str, make, kind: str, new: dict[str, str]) -> DataFrame:
    """df without the columns in new, and those, made of the values of expr."""
    ship(df.sparkSession)
    carry = [c for c in df.columns if c not in new]
    plain = df.select(F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(carry))).alias("row"), expr.alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 256):
                own = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([own.column("row"), *make(own.column(name))], ["row", *new])

    out = plain.mapInArrow(run, f"row {plain.schema['row'].dataType.simpleString()}, " + ", ".join(f"`{c}` {t}" for c, t in new.items()))
    return out.select(*(F.col(f"row.k{i}").alias(c) for i, c in enumerate(carry)), *(F.col(f"`{c}`") for c in new))


def texts_to_media(df: DataFrame, text: str = "text") -> DataFrame:
    """df and the columns media (a WAV file of the text's bytes) and n_bytes (the text's, unpadded)."""

    def make(texts):
        data = [b or b"" for b in texts.cast(pa.binary()).to_pylist()]
        return pa.array(map(store_as_wav, data), pa.binary()), pa.array(map(len, data), pa.int64())

    return _mapped(df, F.col(f"`{text}`").cast("string"), "text_", make, "", {"media": "binary", "n_bytes": "long"})


def sniff_media(df: DataFrame, media: str = "media", declared: str | None = None) -> DataFrame:
    """df and the columns media_type (what the bytes are), corrected (they aren't what `declared` says) and embedded."""

    def make(values):
        magic, kinds, embedded = automaton(), [], []
        for v in values.to_pylist():
            found = sniff(v, magic) if v is not None else []
            whole = [x for x in found if x[1] == 0]
            kinds.append(None if v is None else whole[0][0] if whole else UNKNOWN)
            embedded.append([{"kind": k, "start": s, "length": n} for k, s, n in found if s or (k, s, n) not in whole[:1]])
        return pa.array(kinds, pa.string()), pa.array(embedded, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))

    out = _mapped(df, F.col(f"`{media}`").cast("binary"), "media_", make, "", {"media_type": "string", "embedded": FOUND})
    return out.withColumn("corrected", ~F.col("media_type").eqNullSafe(F.col(f"`{declared}`")) if declared else F.lit(None).cast("boolean"))


def carve_media(df: DataFrame, media: str = "media") -> DataFrame:
    """A row for each embedded file that sniff_media found in `media`, with the other columns of df and kind, start, length and data (its bytes)."""
    new = ("kind", "start", "length", "data")
    found = df.select(F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(df.columns))).alias("row"), F.explode("embedded").alias("x"), F.col(f"`{media}`").cast("binary").alias("media_"))
    kept = [F.col(f"row.k{i}").alias(c) for i, c in enumerate(df.columns) if c not in (*new, media, "embedded")]
    return found.select(*kept, "x.kind", "x.start", "x.length", part_of(F.col("media_"), F.col("x")).alias("data"))


def part_of(media, found):
    """The bytes of one embedded file."""
    return F.substring(media, (found.start + 1).cast("int"), found.length.cast("int"))


def read_back(df: DataFrame, media: str = "media") -> DataFrame:
    """df and, of the WAV values among `media`, payload (the samples' bytes) and feature (of those; null for others)."""

    def make(values):
        payloads, features = [], []
        for v in values.to_pylist():
            if v is None or not _wav(v, 0):
                payloads.append(None)
                features.append(None)
                continue
            samples = wav_samples(v)
            x = np.frombuffer(samples, np.uint8)
            counts = np.bincount(x, minlength=256)
            share = counts[counts > 0] / max(1, len(x))
            mean = float(counts @ np.arange(256)) / max(1, len(x))
            power = float(counts @ (np.arange(256.0) - 128) ** 2) / max(1, len(x))
            crossings = int(np.count_nonzero(np.diff(x >= 128)))
            features.append(f"pcm_u8 rate={RATE} samples={len(x)} mean={mean:.4f} rms={power ** 0.5:.4f} entropy={-(share * np.log2(share)).sum() + 0.0:.4f} crossings={crossings}")
            payloads.append(samples)
        return pa.array(payloads, pa.binary()), pa.array(features, pa.string())

    return _mapped(df, F.col(f"`{media}`").cast("binary"), "media_", make, "", {"payload": "binary", "feature": "string"})
