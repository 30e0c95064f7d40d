"""Vectorised splitting and hashing of words and lines, straight on Arrow's UTF-8 buffers.

A word is a maximal run of bytes other than ``\\x20 \\x09-\\x0D``. Its hash is a polynomial modulo 2**64 with
random byte weights, taken from one running sum for all words of a block, then mixed. Texts are worked on in
blocks of BLOCK bytes cut between words, so that memory doesn't grow with a text's length.
"""

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 20
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
_MIX1, _MIX2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WEIGHT = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
WEIGHT_LOWER = WEIGHT[LOWER]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (int(n) - 1).bit_length())
        have = np.ones(size, U)
        have[1:] = base & 0xFFFFFFFFFFFFFFFF
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(33))
    h *= _MIX1
    h ^= h >> U(33)
    h *= _MIX2
    h ^= h >> U(33)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets; a null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    if at is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8), offsets - offsets[0]


def spans(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of all words; a text's end ends a word."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = np.zeros(n + 2, bool)
    np.logical_not(space[buf], out=ink[1:-1])
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    inner = ink[1:-1]
    return np.flatnonzero(inner & (~ink[:-2] | cut[:-1])), np.flatnonzero(inner & (~ink[2:] | cut[1:])) + 1


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray = WEIGHT) -> np.ndarray:
    """The hash of each span (spans in ascending order, not overlapping)."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        high = ends[j - 1]
        if high - low > 4 * BLOCK:  # one span that fills many blocks
            total, at = 0, 0
            while low + at < high:
                part = weight[buf[low + at : min(high, low + at + BLOCK)]]
                total += int((part * powers(_P, len(part))).sum(dtype=U)) * pow(_P, at, 1 << 64)
                at += len(part)
            out[i] = total & 0xFFFFFFFFFFFFFFFF
        else:
            sums = np.zeros(high - low + 1, U)
            np.cumsum(weight[buf[low:high]] * powers(_P, high - low), out=sums[1:])
            a, b = starts[i:j] - low, ends[i:j] - low
            out[i:j] = (sums[b] - sums[a]) * powers(_INV, high - low + 1)[a]
        i = j
    return mix(out)


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text where its words start among them (n + 1 numbers)."""
    buf, offsets = buffers(texts)
    starts, ends = spans(buf, offsets)
    return hash_spans(buf, starts, ends, WEIGHT_LOWER if lower else WEIGHT), np.searchsorted(starts, offsets)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, len(words) - n + 1 of them; those that reach over a text's end count too."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    total = words[:m].copy()
    for j in range(1, n):
        total *= U(_P)
        total += words[j : j + m]
    return mix(total + U(n))


def pieces(texts: pa.Array, most: int = BLOCK):
    """(from, to) ranges of rows that hold about `most` bytes each, one row at least."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets = buffers(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j
