"""Vectorised word splitting and hashing over batches of whole texts.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere in this subpackage.  UTF-8 keeps
those six separators as single bytes, so splitting works on bytes.  A word's
name is a 64-bit polynomial of its bytes, finished with an avalanche step; it
depends on nothing but the word, so every executor gives it the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SEPARATORS = b" \t\n\x0b\x0c\r"
#: Bytes of text worked on together; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_R = _U(0x9E3779B97F4A7C15 | 1)
_IS_SEPARATOR = np.zeros(256, dtype=bool)
_IS_SEPARATOR[list(SEPARATORS)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = int(_R)) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i mod 2**64 for i < n, r being the (odd) base."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        up, down = np.full(size, _U(base), dtype=np.uint64), np.full(size, _U(pow(base, -1, 1 << 64)), dtype=np.uint64)
        up[0] = down[0] = 1
        got = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 8 * CHUNK_BYTES:  # for one very long text: not kept
            return got
        _powers[base] = got
    return _powers[base]


def byte_names(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = int(_R)) -> np.ndarray:
    """64-bit names of the byte strings raw[starts[i]:ends[i]]; another odd base gives independent ones."""
    up, down = powers(len(raw) + 1, base)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[raw] * up[: len(raw)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


@dataclass
class Words:
    """The words of some documents, one after the other."""

    names: np.ndarray  # uint64 for each word
    offsets: np.ndarray  # word offset of each document; one more than documents
    starts: np.ndarray  # first byte of each word in ``data``
    ends: np.ndarray  # byte after it
    data: bytes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def docs(self) -> np.ndarray:
        """Document index of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def split_words(texts: list[bytes]) -> Words:
    """Words of whole texts (a null text must come as b"")."""
    data = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(data, dtype=np.uint8)
    sep = _IS_SEPARATOR[raw]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if not sep[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    names = byte_names(raw, starts, ends)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    return Words(names, np.searchsorted(starts, at).astype(np.int64), starts, ends, data)


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about ``limit`` bytes together."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def window_names(names: np.ndarray, k: int) -> np.ndarray:
    """Names of all windows of k consecutive names (windows may cross documents)."""
    n = len(names) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    if k <= 8:
        out = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            out = out * _R + names[i : i + n]
        return mix(out)
    up, down = powers(len(names) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(names * up[: len(names)], dtype=np.uint64)))
    return mix((sums[k:] - sums[:-k]) * down[:n])


def whole(offsets: np.ndarray, k: int) -> np.ndarray:
    """Indices of the windows of k words that lie within one document."""
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    first = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return first + np.arange(total)


def count_words(texts: list[bytes]) -> np.ndarray:
    """Number of words of each text."""
    out = []
    for a, b in chunks([len(t) for t in texts]):
        raw = np.frombuffer(b"\n" + b"\n".join(texts[a:b]) + b"\n", dtype=np.uint8)
        sep = _IS_SEPARATOR[raw]
        starts = np.flatnonzero(sep[:-1] & ~sep[1:])
        at = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
        out.append(np.diff(np.searchsorted(starts, at)))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, dtype=np.int64)


class Numbers:
    """A hash table from 64-bit numbers to 32-bit ones, looked up and filled by arrays."""

    def __init__(self, room: int = 1 << 12):
        self.keys, self.values, self.count = np.full(room, -1, dtype=np.int64), np.zeros(room, dtype=np.int32), 0

    def _first(self, keys: np.ndarray) -> np.ndarray:
        shift = np.uint64(64 - (len(self.keys).bit_length() - 1))
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys (0 or more); -1 where there is none."""
        at, out, left = self._first(keys), np.full(len(keys), -1, dtype=np.int32), None
        while len(keys):
            found = self.keys[at]
            hit = found == keys
            if left is None:
                out[hit] = self.values[at[hit]]
            else:
                out[left[hit]] = self.values[at[hit]]
            on = np.flatnonzero(~hit & (found >= 0))
            left = on if left is None else left[on]
            keys, at = keys[on], (at[on] + 1) & (len(self.keys) - 1)
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        if 2 * (self.count + len(keys)) > len(self.keys):
            old = self.keys >= 0
            more = self.keys[old], self.values[old]
            room = 1 << int(3 * (self.count + len(keys))).bit_length()
            self.keys, self.values = np.full(room, -1, dtype=np.int64), np.zeros(room, dtype=np.int32)
            keys, values = np.concatenate((more[0], keys)), np.concatenate((more[1], values))
            self.count = 0
        self.count += len(keys)
        at = self._first(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & (len(self.keys) - 1)
