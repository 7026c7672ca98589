"""Vectorised byte scans over Arrow string columns.

A batch of texts is one run of bytes with offsets.  Words, lines and their
64-bit hashes come from a handful of numpy passes over it; a text is never
looped over by character.  Words are maximal runs of bytes other than
space and 0x09-0x0D; matches never cross a text's edge.  Null texts count as
empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32

PRIME = (1 << 61) - 1
#: Texts are scanned in runs of this many bytes, which bounds what a worker holds beside them.
RUN = 1 << 18
_STEP = 1 << 16
U = np.uint64


_P, _30, _31 = U(PRIME), U(30), U(31)
_LOW31, _LOW30 = U((1 << 31) - 1), U((1 << 30) - 1)
#: Two fixed points, drawn once at random, at which texts are evaluated as polynomials modulo the prime.
_BASES = (0x1B47C0A6D1E5F3A7 % PRIME, 0x0E63A95B7C21D84F % PRIME)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2^61 - 1, or up to 7 more than that."""
    return (x & _P) + (x >> U(61))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1 (or up to 7 more), by halves of 31 bits; 2^62 counts as 2, 2^61 as 1."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _fold(a1 * b1 * U(2) + (middle >> _30) + ((middle & _LOW30) << _31) + a0 * b0)


def _powers(base: int, n: int) -> np.ndarray:
    out, x = np.empty(n, np.uint64), 1
    for i in range(n):
        out[i] = x
        x = x * base % PRIME
    return out


_LOW = [_powers(b, _STEP) for b in _BASES]
_HALVES = [(p & _LOW31, p >> _31) for p in _LOW]
_LOW_INVERSE = [_powers(pow(b, -1, PRIME), _STEP) for b in _BASES]


def text_chunks(column: pa.Array, limit: int = RUN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes; a longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if column.null_count:
        valid = np.asarray(column.is_valid())
        size = np.where(valid, np.diff(offs), 0)
        if (size != np.diff(offs)).any():  # a null over stored bytes
            yield from text_chunks(pa.array([x or "" for x in column.to_pylist()], pa.large_string()), limit)
            return
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def lookup(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """table[data], in runs: an index array takes eight bytes a byte."""
    out = np.empty(len(data), table.dtype)
    for a in range(0, len(data), RUN):
        out[a : a + RUN] = table[data[a : a + RUN]]
    return out


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """Hash of the bytes of every span; starts and ends must each ascend. base: 0 or 1, for two independent hashes.

    The bytes are the coefficients of a polynomial modulo the prime 2^61 - 1, so
    two different spans of n bytes agree at no more than n of its points, however
    they are built.  Sums are kept for 64 KB at a time only; a span over several
    of those runs adds them up.
    """
    runs = (len(data) >> 16) + 1
    whole = np.zeros(runs + 1, np.uint64)  # of all before each run, from the text's beginning
    high = _powers(pow(_BASES[base], _STEP, PRIME), runs)
    lo, hi = (np.zeros(_STEP + 1, np.uint64) for _ in range(2))
    out = [np.empty(len(x), np.uint64) for x in (start, end)]
    done = [0, 0]
    for j, at in enumerate(range(0, len(data) + 1, _STEP)):
        d = data[at : at + _STEP].astype(np.uint64) + U(1)
        n = len(d)
        np.cumsum(d * _HALVES[base][0][:n], out=lo[1 : n + 1])
        np.cumsum(d * _HALVES[base][1][:n], out=hi[1 : n + 1])
        for k, place in enumerate((start, end)):
            upto = done[k] + int(np.searchsorted(place[done[k] :], at + _STEP))
            i = place[done[k] : upto] - at
            h = _fold(hi[i])
            out[k][done[k] : upto] = _fold(_fold(lo[i]) + (((h & _LOW30) << _31) | (h >> _30)))
            done[k] = upto
        h = int(hi[n]) % PRIME
        whole[j + 1] = (int(whole[j]) + (int(lo[n]) + (h << 31)) * int(high[j])) % PRIME
    first, last = out
    sums = _fold(last + (_P + _P - first))
    far = np.flatnonzero((start >> 16) != (end >> 16))
    if far.size:
        a, z = start[far] >> 16, end[far] >> 16
        upto = lambda j, x: _fold(whole[j] + _times(high[j], x))
        back = _powers(pow(_BASES[base], -_STEP, PRIME), runs)
        sums[far] = _times(_fold(upto(z, last[far]) + (_P + _P - upto(a, first[far]))), back[a])
    sums = _times(sums, _LOW_INVERSE[base][start & (_STEP - 1)])
    sums = np.where(sums >= _P, sums - _P, sums)
    return mix(sums + (end - start).astype(np.uint64) * U(0x9E3779B97F4A7C15))


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and row of every word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = lookup(~IS_SPACE, data)
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    edge = offs[(offs > 0) & (offs < len(data))]
    before[edge] = after[edge - 1] = True
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def shingles(word_hash: np.ndarray, row: np.ndarray, n_rows: int, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every k-word window; with ``short``, a row of fewer words gives its whole sequence as one."""
    count = np.bincount(row, minlength=n_rows)
    m = len(word_hash)
    found, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a in range(0, m - k + 1, RUN):
        b = min(a + RUN, m - k + 1)
        whole = row[a + k - 1 : b + k - 1] == row[a:b]
        acc = np.zeros(b - a, np.uint64)
        for j in range(k):
            acc = acc * U(0xD6E8FEB86659FD93) + word_hash[a + j : b + j]
        found.append(mix(acc[whole]))
        rows.append(row[a:b][whole])
    sh, sr = np.concatenate(found), np.concatenate(rows)
    if short and (few := np.flatnonzero((count > 0) & (count < k))).size:
        first = np.concatenate([[0], np.cumsum(count)])[few]
        acc = np.full(few.size, U(0x51ED27), np.uint64) + count[few].astype(np.uint64)
        for j in range(k - 1):
            has = count[few] > j
            acc = np.where(has, acc * U(0xD6E8FEB86659FD93) + word_hash[np.minimum(first + j, m - 1)], acc)
        sh, sr = np.concatenate([sh, mix(acc)]), np.concatenate([sr, few])
    return sh, sr
