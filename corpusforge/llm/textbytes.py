"""Vectorised views of text columns as UTF-8 bytes, for use inside Arrow tasks.

A batch of texts is one byte buffer plus row offsets. Words are runs of bytes
outside ``\\x20`` and ``\\x09-\\x0D``; those six bytes never occur inside a
multi-byte UTF-8 character, so byte runs and character runs agree. Hashes are
64-bit names of byte strings (products mod 2**64 with an odd base, then a
finalizer); they are the same in every task and every run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX1 = U64(0xBF58476D1CE4E5B9)
_MIX2 = U64(0x94D049BB133111EB)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def finalize(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits (public splitmix finalizer)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(30))
        h = h * _MIX1
        h ^= h >> U64(27)
        h *= _MIX2
        h ^= h >> U64(31)
    return h


BYTE_NAME = finalize(np.arange(1, 257, dtype=np.uint64) * U64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        done = 1
        while done < n:
            step = U64(pow(base, done, 1 << 64))
            m = min(done, n - done)
            out[done : done + m] = out[:m] * step
            done += m
    return out


class Powers:
    """Growing tables of powers of the base and of its inverse, one per process."""

    up = _powers(_BASE, 1 << 12)
    inverse = pow(_BASE, -1, 1 << 64)
    down = _powers(inverse, 1 << 12)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(_BASE, size), _powers(cls.inverse, size)
        return cls.up, cls.down


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. offsets has rows + 1 entries."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs_of_rows(offsets: np.ndarray, limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes (one row at least), so that work arrays stay small."""
    out, start, n = [], 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        out.append((start, stop))
        start = stop
    return out


#: separators of plain words: every ASCII byte that is no letter or digit
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = False
NOT_WORD[128:] = False


def word_spans(
    data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = IS_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word, in order. Words do not cross row ends."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = np.empty(n + 1, dtype=bool)
    np.logical_not(separators[data], out=inside[:n])
    inside[n] = False
    before = np.empty(n + 1, dtype=bool)
    before[0] = False
    before[1:] = inside[:n]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    start = np.flatnonzero(inside & (~before | cut))
    end = np.flatnonzero(before & (~inside | cut))
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit name of each word (A-Z lower-cased if asked)."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    up, down = Powers.get(len(data) + 1)
    table = BYTE_NAME[LOWER] if lower else BYTE_NAME
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=run[1:])
        h = (run[end] - run[start]) * down[start]
        h ^= (end - start).astype(np.uint64) * _MIX2
    return finalize(h)


def shingle_hashes(words: np.ndarray, row: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(name, row) of each run of ``size`` words; a row of fewer words has its whole sequence as one."""
    counts = np.bincount(row, minlength=n_rows)
    first = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        m = len(words) - size + 1
        if m > 0:
            h = words[:m].copy()
            for k in range(1, size):
                h = finalize(h * U64(_BASE) + words[k : k + m])
            keep = row[:m] == row[size - 1 :]
            full_h, full_row = h[keep], row[:m][keep]
        else:
            full_h, full_row = np.zeros(0, np.uint64), np.zeros(0, row.dtype if len(row) else np.int64)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short) == 0:
            return full_h, full_row
        names = np.empty(len(short), dtype=np.uint64)
        for i, r in enumerate(short):
            w = words[first[r] : first[r] + counts[r]]
            h = w[0] ^ U64(int(counts[r]))
            for x in w[1:]:
                h = finalize(np.array([h * U64(_BASE) + x], dtype=np.uint64))[0]
            names[i] = h
    h = np.concatenate([full_h, names])
    r = np.concatenate([full_row, short])
    order = np.argsort(r, kind="stable")
    return h[order], r[order]


def distinct_per_row(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, name), sorted by row, then name."""
    if len(h) == 0:
        return h, row
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.empty(len(h), dtype=bool)
    keep[0] = True
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep]
