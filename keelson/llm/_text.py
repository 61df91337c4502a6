"""Words of Arrow string columns and their 64-bit hashes, by numpy over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_ws = np.ones(256, bool)
_ws[[0x20, *range(0x09, 0x0E)]] = False
#: bytes of words that whitespace ends, [^\x20\x09-\x0D]
NOT_SPACE = _ws
_an = np.zeros(256, bool)
_an[0x30:0x3A] = _an[0x41:0x5B] = _an[0x61:0x7B] = True
_an[0x80:] = True
#: bytes of words of digits, letters and what is not ASCII (A-Z count as lower-cased)
ALNUM = _an
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


_byte = stream(11, 256)
#: the same with A-Z as a-z
_folded = _byte.copy()
_folded[0x41:0x5B] = _byte[0x61:0x7B]
_P = 0xD6E8FEB86659FD93
_Pinv = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, U), "q": np.ones(1, U)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        m = max(n, BLOCK + 1)
        for k, base in (("p", _P), ("q", _Pinv)):
            x = np.full(m, base, U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["p"], _powers["q"]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    buf = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return buf, off - off[0]


class Words:
    """Words of a run of texts: start and end bytes, hash (A-Z as a-z if fold); text i has words at[i] to at[i + 1]."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, of: np.ndarray, fold: bool = True):
        self.buf, n = buf, len(buf)
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash, self.at = np.zeros(0, U), np.zeros(len(off), np.int64)
            return
        inside = of[buf]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        first = off[:-1][off[:-1] < n]
        before[first] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        last = off[1:][off[1:] > 0] - 1
        after[last] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.at = np.searchsorted(self.start, off)
        self.hash = self._hash(_folded if fold else _byte)

    def _hash(self, values: np.ndarray) -> np.ndarray:
        out, k, m = np.empty(len(self.start), U), 0, len(self.start)
        while k < m:  # blocks bound what is held for each byte
            lo = self.start[k]
            j = max(k + 1, int(np.searchsorted(self.end, lo + BLOCK, "right")))
            hi = self.end[j - 1]
            p, q = _power(int(hi - lo) + 1)
            total = np.zeros(hi - lo + 1, U)
            np.cumsum(values[self.buf[lo:hi]] * p[: hi - lo], out=total[1:])
            s, e = self.start[k:j] - lo, self.end[k:j] - lo
            out[k:j] = mix((total[e] - total[s]) * q[s] + (e - s).astype(U))
            k = j
        return out

    def doc(self) -> np.ndarray:
        """Of each word, the number of its text."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    _, off = buffers(batch.column(batch.schema.get_field_index(column)))
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row within a text, and their offsets by text; a text of fewer words, but not none, is one shingle of all its words."""
    count = np.diff(w.at)
    if n == 1:
        return mix(w.hash), w.at
    m = len(w.hash)
    h = np.zeros(m, U)
    for k in range(n):
        h[: m - k] = mix(h[: m - k] * U(_P) + w.hash[k:])
    each = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(each)])
    take = np.repeat(w.at[:-1] - at[:-1], each) + np.arange(at[-1])
    out = h[take]
    for i in np.flatnonzero((count < n) & (count > 0)):
        x = np.array([count[i]], U)
        for k in range(w.at[i], w.at[i + 1]):
            x = mix(x * U(_P) + w.hash[k : k + 1] + U(1))
        out[at[i]] = x[0]
    return out, at


def long_list(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """An Arrow list<int64> column."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == U else values.astype(np.int64)))
