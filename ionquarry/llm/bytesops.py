"""Vectorised kernels over the UTF-8 buffers of Arrow string columns.

Every kernel works on one *chunk*: the bytes of some whole texts laid end to end, with the offsets that part them. Texts
are never cut. A chunk holds about ``CHUNK`` bytes or one longer text. Words are found and hashed in blocks of at most
twice that, with some 60 bytes of memory for each byte of a block; what grows with a longer text is 24 bytes for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_RANDOM = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 0-9, A-Z, a-z and whatever is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: all but space, \t, \n, \v, \f, \r.
NONSPACE = np.ones(256, bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b)]), dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, at - at[0]


def chunks(batch: pa.RecordBatch, name: str, size: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch of about ``size`` bytes of text each, with the text's bytes and offsets."""
    size = size or CHUNK
    data, at = buffers(batch.column(batch.schema.get_field_index(name)))
    first, rows = 0, batch.num_rows
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of ``kind`` within each text; the index of each text's first word (n + 1)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    own = kind[data]
    opens, shuts = own.copy(), own.copy()
    opens[1:] &= ~own[:-1]
    shuts[:-1] &= ~own[1:]
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    opens[inner] = own[inner]
    shuts[inner - 1] = own[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    return starts, ends, np.searchsorted(starts, at)


def prefix_hash(data: np.ndarray, lower: bool = True) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any span."""
    table = _RANDOM[LOWER] if lower else _RANDOM
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal bytes have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def gram_hash(items: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive items from each position on; there are len(items) - n + 1, or none."""
    count = len(items) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out *= _BASE
        out += items[j : j + count]
    return mix(out)


def within(firsts: np.ndarray, n: int, count: int) -> np.ndarray:
    """Whether the n items from each position on belong to one text; firsts: as of ``words``."""
    out = np.ones(max(count, 0), bool)
    for k in range(1, n):
        cut = firsts[1:-1] - k
        out[cut[(cut >= 0) & (cut < len(out))]] = False
    # a cut lies before an item, so that windows that start up to n - 1 items earlier cross it
    return out


def _parts(data: np.ndarray, kind: np.ndarray, size: int) -> list[int]:
    """Bounds of blocks of about ``size`` bytes, each behind a byte that belongs to no word; a longer word stays whole."""
    out = [0]
    while len(data) - out[-1] > size:
        at, reach = out[-1], size
        while True:
            free = np.flatnonzero(~kind[data[at : at + reach]])
            if len(free) or at + reach >= len(data):
                break
            reach *= 2
        out.append(at + int(free[-1]) + 1 if len(free) else len(data))
    return out if out[-1] == len(data) else [*out, len(data)]


def word_hashes(data: np.ndarray, at: np.ndarray, kind: np.ndarray, size: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words, and the index of each text's first one.

    Long texts are worked off in blocks, so that only what the words need, 24 bytes each, grows with the longest one.
    """
    size = size or 2 * CHUNK
    if len(data) <= size:
        starts, ends, firsts = words(data, at, kind)
        return span_hash(prefix_hash(data), starts, ends), starts, ends, firsts
    found, bounds = [], _parts(data, kind, size)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        inner = at[(at > a) & (at < b)] - a
        starts, ends, _ = words(data[a:b], np.concatenate([[0], inner, [b - a]]), kind)
        found.append((span_hash(prefix_hash(data[a:b]), starts, ends), starts + a, ends + a))
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, starts, ends, np.searchsorted(starts, at)
