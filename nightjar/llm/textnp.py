"""Vectorised word tools over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D.  The helpers
work on slices of a few megabytes, so their memory does not depend on the
size of an Arrow batch or of a partition; only a single text longer than a
slice is held whole.

Words get 64-bit names that depend on their bytes alone: eight bytes at a time
go through a bijective avalanche step that is chained with the result so far
(xxHash for words above LONG_WORD bytes).  Shingles and windows are named by
doubling: the name of a run of 2k entries is made from those of its two halves
by the same step.  No step is linear, so repeated and mirrored patterns (such
as the Thue-Morse word and its complement, which collide under any polynomial
modulo a power of two) get names as unlike as any other texts.  A second family
of names, made with another seed, is independent of the first; both together
are 128 bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
SLICE_BYTES = 1 << 21
#: Words above this many bytes are named by xxHash.
LONG_WORD = 64
#: Seeds of the two families of names.
SEEDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_PAIR, _SIZE = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
#: The first n bytes of a little-endian number of eight.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of letters: A-Z, a-z and every byte of a character beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche step on uint64 values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Slice:
    """Consecutive texts of one column: rows [first, first + n_docs)."""

    first: int
    n_docs: int
    data: np.ndarray  # the bytes of all texts
    starts: np.ndarray  # of each text in data; one more than n_docs


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a column of strings or their bytes into slices of about ``most`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + most, side="right")) - 1)
        last = min(last, n)
        yield Slice(first, last - first, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
        first = last


@dataclass
class Words:
    """The words of a slice: byte spans, 64-bit names, and where each text's words begin."""

    begin: np.ndarray
    end: np.ndarray
    name: np.ndarray
    doc_start: np.ndarray  # index of each text's first word; one more than the texts


def byte_names(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """Names of the byte strings data[begin:end]; the last eight bytes of ``data`` are padding."""
    size = end - begin
    out = mix(size.astype(U64) * _SIZE + U64(seed))
    if not len(out):
        return out
    lanes = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = mix(out ^ (lanes[begin] & _FIRST[np.minimum(size, 8)]))
    at, k = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(at):
        out[at] = mix(out[at] * _PAIR + (lanes[begin[at] + k] & _FIRST[np.minimum(size[at] - k, 8)]))
        k += 8
        at = at[size[at] > k]
    for x in np.flatnonzero(size > LONG_WORD):
        out[x] = xxhash.xxh3_64_intdigest(data[begin[x] : end[x]], seed)
    return out


def words_of(s: Slice, lower: bool = False, member: np.ndarray = _IS_WORD) -> Words:
    """The maximal runs of bytes of which ``member`` is true (white-space separated words, if not given)."""
    return both_words_of(s, lower, member, SEEDS[:1])[0]


def both_words_of(s: Slice, lower: bool = False, member: np.ndarray = _IS_WORD, seeds: tuple[int, ...] = SEEDS) -> list[Words]:
    """``words_of`` with the names of each seed."""
    n = len(s.data)
    if not n:
        none = np.zeros(0, np.int64)
        return [Words(none, none, np.zeros(0, U64), np.zeros(s.n_docs + 1, np.int64)) for _ in seeds]
    data = np.zeros(n + 8, np.uint8)
    data[:n] = _LOWER[s.data] if lower else s.data
    inside = member[data[:n]]
    full = s.starts[:-1] < s.starts[1:]
    heads, tails = s.starts[:-1][full], s.starts[1:][full] - 1
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    edge[heads] = inside[heads]
    begin = np.flatnonzero(edge)
    edge = inside.copy()
    edge[:-1] &= ~inside[1:]
    edge[tails] = inside[tails]
    end = np.flatnonzero(edge) + 1
    del edge, inside
    doc_start = np.searchsorted(begin, s.starts)
    return [Words(begin, end, byte_names(data, begin, end, seed), doc_start) for seed in seeds]


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _PAIR + b)


def _numbered(x: pa.Array) -> np.ndarray:
    """Equal entries by one number above 0, unequal ones by different numbers (compared as they are, not by a hash)."""
    return x.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(U64) + U64(1)


def _join_numbers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _numbered(pa.array((a << U64(32)) | b))


def sequence_names(name: np.ndarray, width: int, join=_join) -> np.ndarray:
    """Names of every run of ``width`` consecutive entries (may span texts), made from those of halves by ``join``."""
    m = len(name) - width + 1
    if m <= 0:
        return np.zeros(0, U64)
    out, used, span, part = None, 0, 1, name
    while True:
        if width & span:  # one more block of ``span`` entries
            block = part[used : used + m]
            out = block if out is None else join(out, block)
            used += span
        if used == width:
            return mix(out ^ U64(width * 0xE7037ED1A0B428DB & (2**64 - 1)))
        part = join(part[:-span], part[span:])
        span *= 2


def numbered_words(s: Slice, lower: bool = False) -> Words:
    """``words_of`` with numbers for names that are equal exactly for equal words of this slice."""
    w = words_of(s, lower)
    if len(w.begin):
        data = _LOWER[s.data] if lower else s.data
        size = w.end - w.begin
        ends = np.cumsum(size)
        letters = np.ascontiguousarray(data[_IS_WORD[data]])
        offsets = np.concatenate([np.zeros(1, np.int64), ends.astype(np.int64)])
        w.name = _numbered(pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]))
    return w


def window_starts(doc_start: np.ndarray, width: int) -> np.ndarray:
    """Which entries start a run of ``width`` entries inside one text (bool per entry, all texts)."""
    n = int(doc_start[-1])
    room = np.repeat(doc_start[1:], np.diff(doc_start)) - np.arange(n)
    return room >= width


def trim() -> None:
    """Hand memory that this Python worker has freed back to the system: a worker is kept for later stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None
