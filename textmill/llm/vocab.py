"""Fast whole-text encoding with the ``tokenizers`` library, a column at a time.

Byte-pair encoders treat every pre-token on its own, so a text's ids are the
concatenation of its pre-tokens' ids.  :class:`FastEncoder` cuts a column of
texts at single blanks and line ends (where no pre-token of either supported
kind can reach across), finds the distinct units of the column in Arrow, looks
those up in a bounded per-process table and asks the library, once a column,
for the units that it has not met.  The ids are then gathered by position, so
the work in Python is by distinct units and not by words.  Texts with any
other white space, control or special-token characters go to the library
whole, so the ids always equal ``Tokenizer.encode(text,
add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import KEPT, takes_over

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units kept by a worker process: at some 200 bytes each, 60 MB.
CACHE_UNITS = 300_000

#: Bytes that end a unit, and those that send a text to the library whole.
_BREAK = np.zeros(256, bool)
_BREAK[[10, 32]] = True
_CONTROL = np.zeros(256, bool)
_CONTROL[[*range(10), *range(11, 32), 127]] = True


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and its offsets
    from 0; views of the column."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _unlike(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[texts] whether a text has white space that isn't single or isn't a
    blank or line end, or stands at its border, or control characters."""
    n = len(data)
    if not n:
        return np.zeros(len(at) - 1, bool)
    gap = _BREAK[data]
    bad = _CONTROL[data]
    bad[1:] |= gap[1:] & gap[:-1]
    some = at[1:] > at[:-1]
    bad[at[:-1][some]] |= gap[at[:-1][some]]
    bad[at[1:][some] - 1] |= gap[at[1:][some] - 1]
    second, third = np.append(data[1:], 0), np.append(data[2:], [0, 0])[:n]
    for lead, rule in (
        (0xC2, lambda b, c: b <= 0xA0),  # U+0080 to U+00A0
        (0xE1, lambda b, c: ((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E))),  # U+1680, U+180E
        (0xE2, lambda b, c: ((b == 0x80) & ((c <= 0x8F) | ((c >= 0xA8) & (c <= 0xAF)))) | ((b == 0x81) & (c >= 0x9F) & (c <= 0xAF))),  # U+2000 to U+206F's blanks and marks
        (0xE3, lambda b, c: (b == 0x80) & (c == 0x80)),  # U+3000
        (0xEF, lambda b, c: (b == 0xBB) & (c == 0xBF)),  # U+FEFF
    ):
        where = np.flatnonzero(data == lead)
        if len(where):
            bad[where] |= rule(second[where], third[where])
    out = np.zeros(len(at) - 1, bool)
    hit = np.flatnonzero(bad)
    if len(hit):
        out[np.searchsorted(at, hit, "right") - 1] = True
    return out


def _byte_letters() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies: bytes
    that print keep their code point, the others follow from 256 upwards."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class FastEncoder:
    """``encode_column(texts)`` gives all ids one after another, and offsets."""

    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.limit = cache_units
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
        self.word_ends = steps[0].get("type") == "Split"
        if self.word_ends:
            self.cut = regex.compile(steps[0]["pattern"]["Regex"])
        else:  # the byte-level pre-tokenizer's fixed pattern
            self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.letters = str.maketrans(dict(zip(map(chr, range(256)), _byte_letters(), strict=True)))
        self.blank = _byte_letters()[32]
        self.known: dict[bytes, int] = {}
        # the known units' ids one after another, and where each begins
        self.flat, self.first, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _ask(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units that aren't known, one after another, and sizes."""
        from unicodedata import normalize

        tokenize, cut, letters, blank, ends = self.model.tokenize, self.cut.findall, self.letters, self.blank, self.word_ends
        ids: list[int] = []
        size = []
        for u in units:
            n = len(ids)
            if u.isascii():
                t = u.decode()
                if ends:
                    t = t.lower().lstrip(" \n")
                bare = t[1:] if t[:1] == " " else t
                for part in (t,) if bare.isalpha() and not ends else cut(t):
                    ids += [x.id for x in tokenize(part.replace(" ", blank) if part != "\n" else part.translate(letters))]
            else:
                t = u.decode("utf-8")
                if ends:
                    t = "".join(c.lower() for c in normalize("NFC", t.lstrip(" \n")))
                for part in cut(t):
                    ids += [x.id for x in tokenize(part.encode("utf-8").decode("latin-1").translate(letters))]
            size.append(len(ids) - n)
        return np.array(ids, np.uint32), np.array(size, np.int64)

    def _keep(self, units: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        at = len(self.known)
        while at + len(units) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.first[at : at + len(units)] = self.used + np.cumsum(size) - size
        self.size[at : at + len(units)] = size
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(units, range(at, at + len(units)), strict=True))

    def _looked_up(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each unit's begin and how many they are."""
        get = self.known.get
        place = np.array([get(u, -1) for u in units], np.int64)
        missing = np.flatnonzero(place < 0)
        if not len(missing):
            return self.flat, self.first[place], self.size[place]
        asked = [units[i] for i in missing.tolist()]
        ids, size = self._ask(asked)
        if len(self.known) + len(asked) <= self.limit:  # by then the frequent units are in
            place[missing] = np.arange(len(self.known), len(self.known) + len(asked))
            self._keep(asked, ids, size)
            return self.flat, self.first[place], self.size[place]
        first, n = self.first[place], self.size[place]
        first[missing], n[missing] = self.used + np.cumsum(size) - size, size
        return np.concatenate([self.flat[: self.used], ids]), first, n

    def _plain(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of texts that :func:`_unlike` lets pass."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        mark = _BREAK[data]
        mark[np.flatnonzero(data == 10) + 1] = True
        mark[at[:-1][at[1:] > at[:-1]]] = True
        starts = np.flatnonzero(mark)
        bounds = np.append(starts, len(data)).astype(np.int32 if len(data) < 1 << 31 else np.int64)
        kind = pa.binary() if bounds.dtype == np.int32 else pa.large_binary()
        units = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        code = units.indices.to_numpy()
        flat, first, size = self._looked_up(units.dictionary.to_pylist())
        n = size[code]
        ends = np.cumsum(n)
        where = np.repeat(first[code] - (ends - n), n)
        where += np.arange(len(where))
        return flat[where], np.append(0, ends)[np.searchsorted(starts, at)]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned, 32 bits) of all texts, and [texts + 1] offsets."""
        data, at = column_bytes(column)
        odd = _unlike(data, at)
        for s in self.specials:
            odd |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._plain(data, at)
        rest, offsets = self._plain(*column_bytes(column.filter(pa.array(~odd))))
        parts, k = [], 0
        for i in range(len(column)):
            if odd[i]:
                parts.append(self._ids(column[i].as_py()))
            else:
                parts.append(rest[offsets[k] : offsets[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit bytes."""
        return self.encode_column(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


_ENCODERS: dict[str, FastEncoder] = {}
KEPT["vocab"] = _ENCODERS.clear


def encoder(path: str) -> FastEncoder:
    """One encoder a process for each vocabulary file."""
    takes_over("vocab")
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = FastEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text, and the new offsets."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
    return out, offsets + np.arange(n + 1)
