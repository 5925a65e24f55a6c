"""Vectorised text primitives over Arrow string buffers: no Python object is made per character, word or shingle.

Every function takes the UTF-8 bytes of many rows laid end to end and the offsets of the rows in them, so one
call handles a chunk of whole documents. Chunks never cut a document: one longer than the limit is a chunk alone, whose
working arrays are made block by block, so that it takes some ten bytes for each of its own and not fifty.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space of the word contracts (\x20 and \x09 to \x0D).
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: White space and ASCII punctuation.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

CHUNK = 512 << 10
#: Bytes of a text whose wide working arrays are held at a time.
BLOCK = 1 << 20

_odd = np.zeros(0, np.uint64)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 row offsets of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def chunks(buf, offsets, limit=CHUNK):
    """(first row, end row, bytes, offsets) of runs of whole rows of up to limit bytes, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def code_points(buf) -> tuple[np.ndarray, np.ndarray]:
    """(byte offset, code point) of every character."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    b = buf[at].astype(np.int64)
    point = b.copy()
    wide = np.flatnonzero(b >= 0xC0)
    if len(wide):
        tail = np.append(buf, np.zeros(3, np.uint8)).astype(np.int64) & 0x3F
        for lo, hi, bits, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
            some = wide[(b[wide] >= lo) & (b[wide] < hi)]
            p = b[some] & bits
            for j in range(1, more + 1):
                p = (p << 6) | tail[at[some] + j]
            point[some] = p
    return at, np.minimum(point, 0x10FFFF)


def _word_edges(gap, cut, lo, hi):
    """Places at which words start and end in gap[lo:hi]; cut: rows start there, which parts words as well."""
    here = gap[lo:hi]
    left, right = np.empty(hi - lo, bool), np.empty(hi - lo, bool)
    left[0], left[1:] = lo == 0 or gap[lo - 1], here[:-1]
    right[-1], right[:-1] = hi == len(gap) or gap[hi], here[1:]
    inside = cut[np.searchsorted(cut, lo) : np.searchsorted(cut, hi)]
    left[inside - lo] = True
    inside = cut[np.searchsorted(cut, lo + 1) : np.searchsorted(cut, hi, "right")]
    right[inside - 1 - lo] = True
    return np.flatnonzero(~here & left) + lo, np.flatnonzero(~here & right) + lo + 1


def words(buf, offsets, lower=True, gaps=SPACE):
    """(bytes of all words end to end, int64 offsets of the words, index of each row's first word and the end).

    gaps: for each byte value whether it parts words."""
    gap = gaps[buf]
    found = [_word_edges(gap, offsets, lo, min(lo + BLOCK, len(buf))) for lo in range(0, len(buf), BLOCK)]
    starts, ends = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
    data = buf[~gap]
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    return (LOWER[data] if lower else data), at, np.searchsorted(starts, offsets)


def _coefficients(n: int) -> np.ndarray:
    global _odd
    if len(_odd) < n:
        x = np.arange(1, max(n, 256) * 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        _odd = (x ^ (x >> np.uint64(31))) | np.uint64(1)
    return _odd


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashes(data, at) -> np.ndarray:
    """A 64-bit multilinear hash of each segment data[at[i]:at[i+1]]; segments are not empty."""
    n = len(at) - 1
    out, lo = np.zeros(max(0, n), np.uint64), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (BLOCK >> 2), "right")) - 1)
        edge = at[lo : hi + 1] - at[lo]
        size = np.diff(edge)
        odd = _coefficients(int(size.max()) + 1)
        part = odd[np.arange(edge[-1]) - np.repeat(edge[:-1], size)]
        part *= data[at[lo] : at[hi]].astype(np.uint64) + np.uint64(1)
        out[lo:hi] = mix(np.add.reduceat(part, edge[:-1]) + size.astype(np.uint64))
        lo = hi
    return out


def shingles(word_hashes, first, k: int):
    """For each row the sorted distinct hashes of its k-word shingles; a row of 1 to k-1 words is one shingle."""
    n = len(word_hashes)
    grams = np.full(max(0, n - k + 1), k, np.uint64)
    for j in range(k):
        grams = mix(grams + word_hashes[j : n - k + 1 + j]) if len(grams) else grams
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for j in range(a, b):
                one = mix(one + word_hashes[j : j + 1])
            yield one
        else:
            yield np.zeros(0, np.uint64)


def binary(data, at) -> pa.Array:
    """The segments as an Arrow binary array that shares the bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
