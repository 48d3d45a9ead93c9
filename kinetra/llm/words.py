"""Words of UTF-8 texts as 64-bit hashes, many texts at a time (numpy over Arrow buffers)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_STEP_INV = pow(_STEP, -1, 2**64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CHUNK_BYTES = 1 << 19


def mix(x):
    """A bijection on 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column):
    """The bytes of an Arrow text column, and the n + 1 places where its texts begin; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def chunks(ends, size=CHUNK_BYTES):
    """Runs (first, last + 1) of texts of about size bytes; a longer text is a run of its own."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, side="right")) - 1)
        yield i, j
        i = j


def word_hashes(raw, ends, lower, spans=False):
    """Hashes of all words in order, and the n + 1 places where each text's words begin; with spans, also each word's first and last + 1 byte."""
    hashes, counts, at = [], [], []
    for i, j in chunks(ends):
        b = raw[ends[i] : ends[j]]
        if lower:
            b = _LOWER[b]
        n = len(b)
        if n == 0:
            counts.append(np.zeros(j - i, np.int64))
            continue
        solid = ~_IS_SPACE[b]
        edge = np.zeros(n + 1, bool)
        edge[ends[i : j + 1] - ends[i]] = True
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:n]
        last[:-1] &= ~solid[1:] | edge[1:n]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        powers = np.full(n, _STEP, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[b] * powers, out=total[1:])
        # dividing by the power at the start makes the hash independent of the place
        back = np.full(n, _STEP_INV, np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        hashes.append(mix((total[stops] - total[starts]) * back[starts] + (stops - starts).astype(np.uint64)))
        if spans:
            at.append(np.stack([starts, stops]) + ends[i])
        counts.append(np.diff(np.searchsorted(starts, ends[i : j + 1] - ends[i])))
    places = np.zeros(len(ends), np.int64)
    if counts:
        np.cumsum(np.concatenate(counts), out=places[1:])
    found = (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), places
    return (*found, np.concatenate(at, axis=1) if at else np.zeros((2, 0), np.int64)) if spans else found


def windows(h, size):
    """Hash of each run of size consecutive entries (runs across texts included)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    weight = 1
    for k in range(size):
        out += h[k : k + n] * np.uint64(weight)
        weight = weight * 0xD1342543DE82EF95 % 2**64
    return mix(out)


def inside(places, size, n):
    """For each of n window starts, whether the window ends within the text where it starts."""
    owner_end = np.repeat(places[1:], np.diff(places))[:n]
    return np.arange(n) + size <= owner_end
