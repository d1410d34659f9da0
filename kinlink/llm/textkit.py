"""Vectorised byte-level text handling shared by the Arrow-side operators.

Texts stay in the Arrow data buffer; words, hashes and n-grams are computed
for a whole slice of documents at once, so no per-word Python object exists.
"""

from __future__ import annotations

import ctypes
import inspect
import os

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVBASE = pow(_BASE, -1, 2**64)
_GRAM = [U64(x * 2 + 1) for x in _rng.integers(1, 2**62, 64).tolist()]
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower case
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


_TRIM_OVER = 16 << 20
_kept = 0


def private_bytes() -> int:
    """Memory of this process that is not mapped from files; 0 where the system does not tell."""
    try:
        with open("/proc/self/statm") as f:
            size = f.read().split()
    except OSError:
        return 0
    return (int(size[1]) - int(size[2])) * os.sysconf("SC_PAGE_SIZE")


def tidy() -> None:
    """Hands memory that was freed back to the machine, where this process has grown since the last time."""
    global _kept
    if private_bytes() <= _kept + _TRIM_OVER:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass
    _kept = private_bytes()


def frugal(f):
    """f, a function of Arrow batches or of a group's table, that tidies up when it ends: Python workers outlive their tasks."""

    def of_batches(batches):
        yield from f(batches)
        tidy()

    def of_group(table):
        out = f(table)
        tidy()
        return out

    return of_batches if inspect.isgeneratorfunction(f) else of_group


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64, up to n."""
    global _POW, _INV
    if len(_POW) < n + 1:
        m = max(n + 1, 1 << 16)
        for name, base in (("_POW", _BASE), ("_INV", _INVBASE)):
            out = np.full(m, base, np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            globals()[name] = out
    return _POW, _INV


def buffer_of(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    n = len(arr)
    if n == 0 or arr.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(off: np.ndarray, most: int):
    """Ranges of documents with at most `most` bytes together, or one longer document."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b
        a = b


def words(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray):
    """Starts and ends of the words, and for each document the index of its first word (n+1 values)."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = is_word[buf]
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    at = off[(off > 0) & (off < n)]
    first[at] = w[at]
    last[at - 1] = w[at - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """C with hash(a, b) = (C[b] - C[a]) * INV[a]."""
    p, _ = powers(len(buf))
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * p[: len(buf)], out=c[1:])
    return c


def span_hash(c: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by content and length."""
    _, inv = powers(len(c))
    return mix((c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64) * _GRAM[63])


def word_hash(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time through a nonlinear mixer: no structure of a span cancels out."""
    size = (e - s).astype(np.int64)
    wide = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    h = mix(size.astype(np.uint64) * _GRAM[63] + _GRAM[62])
    at, k = np.flatnonzero(size > 0), 0
    while len(at):
        left = np.minimum(size[at] - k, 8)
        v = wide[s[at] + k] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * left.astype(np.uint64)))
        h[at] = mix((h[at] ^ v) * _GRAM[61] + _GRAM[60])
        k += 8
        at = at[size[at] > k]
    return h


def gram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes; shorter input gives none."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m] * _GRAM[0]
    for i in range(1, n):
        out += h[i : i + m] * _GRAM[i]
    return mix(out)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), then starts[1] ..."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def merge_spans(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal runs; touching spans join."""
    if len(s) == 0:
        return s, e
    o = np.argsort(s, kind="stable")
    s, e = s[o], np.maximum.accumulate(e[o])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    i = np.flatnonzero(new)
    return s[i], e[np.append(i[1:], len(s)) - 1]
