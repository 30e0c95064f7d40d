"""Token ids by the tokenizers library, each distinct stretch of text encoded once for as long as a worker remembers it.

Both kinds of tokenizer cut a text into pre-tokens by its own pattern and encode each by itself, so a text's ids are
its pre-tokens' ids one after another. For texts within Latin-1 the cuts are found here for a whole batch at once, on
arrays of byte kinds, and the pre-tokens are looked up by their exact bytes in a table of arrays. Other texts are cut
at plain white space, where no pre-token can reach over; those for which that isn't plain are encoded whole.
Special tokens' strings in a text are ordinary text.
"""

import json
import os
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

from .words import mix, pieces

U = np.uint64
LONGEST = 23  # bytes of the longest pre-token that is remembered: three integers hold it and its length
MOST = 1 << 20  # remembered pre-tokens, after which the memory starts anew
SLOTS = 1 << 21
MOST_IDS = 1 << 23
SLICE = 1 << 18

#: Letters, digits and white space within Latin-1, and what may follow an apostrophe.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
_ONE_LETTER, _TWO_LETTERS = b"stmd", (b"re", b"ve", b"ll")

LETTER, DIGIT, WHITE, OTHER = 0, 1, 2, 3
_LATIN = bytes(range(256)).decode("latin-1")
_KIND = np.array([LETTER if re.match(f"[{_L}]", c) else DIGIT if re.match(f"[{_N}]", c) else WHITE if re.match(f"[{_S}]", c) else OTHER for c in _LATIN], np.uint8)
_SMALL = np.array([ord(c.lower()) for c in _LATIN], np.uint8)  # of no character here is the lower case outside Latin-1
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], U)
_STRETCH = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")


def _contractions(buf: np.ndarray, kind: np.ndarray, first: np.ndarray, edge: np.ndarray) -> None:
    """Moves the cuts after apostrophes that start a pre-token of their own ('s, 't, 're ...). edge: where a text starts."""
    at = np.flatnonzero(buf[:-3] == 39)  # the buffer ends in three bytes of padding
    at = at[first[at] & (kind[at + 1] == LETTER) & ~edge[at + 1]]
    one = np.isin(buf[at + 1], np.frombuffer(_ONE_LETTER, np.uint8))
    two = np.zeros(len(at), bool)
    for x, y in _TWO_LETTERS:
        two |= (buf[at + 1] == x) & (buf[at + 2] == y)
    two &= ~first[at + 2]  # the second letter belongs to the same run
    first[at[one | two] + 1] = False
    for own, n in ((at[one], 2), (at[two], 3)):
        follows = own + n
        first[follows[kind[follows] == LETTER]] = True


def cut_bytes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of a byte-level tokenizer; buf: Latin-1 bytes and three of padding."""
    n = len(buf) - 3
    kind = np.append(_KIND[buf[:n]], np.full(3, 255, np.uint8))
    first = np.zeros(n + 3, bool)
    first[1 : n + 1] = kind[1 : n + 1] != kind[:n]
    first[offsets] = True
    white = kind == WHITE
    # the last of several white bytes stands alone, or with what follows; a single space stands with what follows
    last = np.flatnonzero(white[:n] & first[1 : n + 1])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    last = last[~edge[last + 1]]
    first[last] = True
    first[last[buf[last] == 32] + 1] = False  # so an apostrophe there starts nothing
    _contractions(buf, kind, first, edge)
    starts = np.flatnonzero(first[:n])
    return starts, np.append(starts[1:], n) if len(starts) else starts


def cut_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of a tokenizer that drops white space; buf: lower-cased, and padded as above."""
    n = len(buf) - 3
    kind = np.append(_KIND[buf[:n]], np.full(3, 255, np.uint8))
    first = np.zeros(n + 3, bool)
    first[1 : n + 1] = (kind[1 : n + 1] != kind[:n]) | (kind[1 : n + 1] == DIGIT)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first[:-2] |= edge
    _contractions(buf, kind, first, edge)
    starts = np.flatnonzero(first[:n])
    ends = np.append(starts[1:], n) if len(starts) else starts
    ink = kind[starts] != WHITE
    return starts[ink], ends[ink]


class _Memory:
    """Ids of pre-tokens, found by their bytes: an open hash table of arrays, and one pool of ids."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.n, self.used = 0, 0
        self.slot = np.full(SLOTS, -1, np.int32)
        self.keys = np.zeros((1 << 16, 3), U)
        self.where = np.zeros((1 << 16, 2), np.int64)  # start and count in the pool
        self.pool = np.zeros(1 << 18, np.uint32)

    @staticmethod
    def slots(keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * U(0x9E3779B97F4A7C15) ^ keys[:, 1] * U(0xC2B2AE3D27D4EB4F) ^ keys[:, 2] * U(0x165667B19E3779F9)
        return (mix(h) & U(SLOTS - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's entry, or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo, at = np.arange(len(keys)), self.slots(keys)
        while len(todo):
            entry = self.slot[at]
            held = entry >= 0
            todo, at, entry = todo[held], at[held], entry[held]
            same = (self.keys[entry] == keys[todo]).all(axis=1)
            out[todo[same]] = entry[same]
            todo, at = todo[~same], (at[~same] + 1) & (SLOTS - 1)
        return out

    def add(self, keys: np.ndarray | None, ids: list[bytes]) -> np.ndarray:
        """New entries for distinct keys that aren't held; without keys they can't be found later."""
        entries = np.arange(self.n, self.n + len(ids))
        flat = np.frombuffer(b"".join(ids), np.uint32)
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        self.keys, self.where = _room(self.keys, self.n + len(ids)), _room(self.where, self.n + len(ids))
        self.pool = _room(self.pool, self.used + len(flat))
        self.where[entries, 0] = self.used + np.cumsum(counts) - counts
        self.where[entries, 1] = counts
        self.pool[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(ids), self.used + len(flat)
        if keys is not None:
            self.keys[entries] = keys
            todo, at = entries, self.slots(keys)
            while len(todo):
                free = self.slot[at] < 0
                self.slot[at[free]] = todo[free]
                left = self.slot[at] != todo
                todo, at = todo[left], (at[left] + 1) & (SLOTS - 1)
        return entries


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """a, or a longer array that starts as a does, with room for n."""
    if n <= len(a):
        return a
    out = np.zeros((max(n, 2 * len(a)), *a.shape[1:]), a.dtype)
    out[: len(a)] = a
    return out


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        before = config.get("pre_tokenizer") or {}
        model = config.get("model") or {}
        self.by_word = (before.get("pretokenizers") or [{}])[0].get("behavior") == "Removed" and bool(model.get("end_of_word_suffix"))
        self.by_byte = before.get("type") == "ByteLevel" and not config.get("normalizer") and not before.get("add_prefix_space")
        self.memory = _Memory()
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word, or begin with its space
        for token, i in vocabulary.items():
            self.edge[i] = token.endswith(model.get("end_of_word_suffix") or "</w>") if self.by_word else token.startswith("Ġ")
        self.plain = re.compile(f"[{_L}]+" if self.by_word else f" [{_L}]+")

    def _of_tokens(self, todo: list[str]) -> list[bytes]:
        """Pre-tokens' ids. Those of letters are encoded many in one text and told apart by their edges."""
        out, rest = {}, []
        fits = self.plain.fullmatch
        plain = []
        for s in todo:
            (plain if fits(s) else rest).append(s)
        for i in range(0, len(plain), 256):
            own = plain[i : i + 256]
            ids = self.tokenizer.encode_batch_fast([(" " if self.by_word else "").join(own)], add_special_tokens=False)[0].ids
            edges = np.flatnonzero(self.edge[ids])
            ends = 4 * (edges + 1) if self.by_word else 4 * np.append(edges[1:], len(ids))
            if len(ends) != len(own):
                raise ValueError("words of letters aren't encoded each by itself")
            data, at = array("I", ids).tobytes(), 0
            for s, end in zip(own, ends.tolist()):
                out[s] = data[at:end]
                at = end
        if rest:
            for s, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
                out[s] = array("I", e.ids).tobytes()
        return [out[s] for s in todo]

    def _entries(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The memory's entry of each pre-token; what it lacks is encoded."""
        memory = self.memory
        if memory.n > MOST or memory.used > MOST_IDS:
            memory.clear()
        raw = buf.tobytes() + bytes(24)
        sizes = ends - starts
        out = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(sizes <= LONGEST)
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from each place on
        keys = np.empty((len(short), 3), U)
        for k in range(3):
            keys[:, k] = eight[starts[short] + 8 * k] & _MASK[np.clip(sizes[short] - 8 * k, 0, 8)]
        keys[:, 2] |= sizes[short].astype(U) << U(56)
        found = memory.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            order = new[np.lexsort(keys[new].T)]
            own = keys[order]
            other = np.ones(len(own), bool)
            other[1:] = (own[1:] != own[:-1]).any(axis=1)
            one = order[other]
            at = short[one]
            todo = [raw[s:e].decode("latin-1") for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            found[order] = memory.add(keys[one], self._of_tokens(todo))[np.cumsum(other) - 1]
        out[short] = found
        long = np.flatnonzero(out < 0)
        if len(long):
            each = [raw[s:e].decode("latin-1") for s, e in zip(starts[long].tolist(), ends[long].tolist())]
            todo = list(dict.fromkeys(each))
            place = dict(zip(todo, memory.add(None, self._of_tokens(todo)).tolist()))
            out[long] = [place[s] for s in each]
        return out

    def _latin(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts in Latin-1."""
        offsets = np.cumsum([0, *map(len, texts)])
        buf = np.frombuffer(b"".join([*texts, b"\0\0\0"]), np.uint8)
        if self.by_word:
            buf = _SMALL[buf]
        starts, ends = (cut_words if self.by_word else cut_bytes)(buf, offsets)
        sums, parts = np.zeros(len(starts) + 1, np.int64), []
        for k in range(0, len(starts), SLICE):  # so that a very long text's pre-tokens aren't all at hand at once
            low, high = starts[k], ends[min(k + SLICE, len(ends)) - 1]
            entries = self._entries(buf[low:high], starts[k : k + SLICE] - low, ends[k : k + SLICE] - low)
            first, counts = self.memory.where[entries].T
            before = np.cumsum(counts) - counts
            parts.append(self.memory.pool[np.repeat(first - before, counts) + np.arange(counts.sum())].tobytes())
            sums[k + 1 : k + 1 + len(counts)] = counts
        sums, ids = np.cumsum(sums), b"".join(parts)
        at = (4 * sums[np.searchsorted(starts, offsets)]).tolist()
        return [ids[s:e] for s, e in zip(at[:-1], at[1:])]

    def _otherwise(self, text: str) -> bytes:
        if self.by_word:
            cut = [x.decode() for x in text.encode().split()]
        elif self.by_byte:
            cut = [text] if _OTHER_SPACE.search(text) else _STRETCH.findall(text)
        else:
            cut = [text]
        return b"".join(array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(cut, add_special_tokens=False))

    def encode(self, texts: list[str]) -> list[bytes]:
        latin, places, out = [], [], [b""] * len(texts)
        for i, t in enumerate(texts):
            try:
                if not (self.by_word or self.by_byte):
                    raise UnicodeEncodeError("latin-1", t, 0, 0, "another kind of tokenizer")
                latin.append(t.encode("latin-1"))
                places.append(i)
            except UnicodeEncodeError:
                out[i] = self._otherwise(t)
        if latin:
            for i, ids in zip(places, self._latin(latin)):
                out[i] = ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer's file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(path: str, texts, most: int = 1 << 19):
    """The ids of each of an Arrow array's texts (null: empty), some at a time."""
    encode = encoder(path).encode
    for i, j in pieces(texts, most):
        yield from encode([t or "" for t in texts.slice(i, j - i).to_pylist()])
