"""Global distinct-word shuffle: every distinct word of a corpus is resolved in one place, then joined back.

Rows are cut into blocks of whole texts. A block's tokens become its distinct words and, for each token in order, the
number of its word (the positions). A word goes to a part chosen by its hash, so equal words of all blocks meet; a
block sends each part one packed row, not a row for each word, so a frequent word costs a part as many entries as there
are blocks and no more. The answers return to the block, where the tokens are put together in their order again.

There are four parts for each partition, up to MOST_PARTS, so that the rows of blocks times parts grow in proportion to a
large corpus; beyond it a part holds its packed words in memory, which grow as the distinct words of all blocks.
"""

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import hashes, utf8
from .workspace import per_batch

#: Bytes of tokens in a block.
BLOCK = 16 << 20
MOST_PARTS = 16_384
ROWS = "block bigint, part int, words binary, sent binary, body binary"
NAMES = ["block", "part", "words", "sent", "body"]
KINDS = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())


def pack(x: np.ndarray) -> bytes:
    """Bytes of an array of integers from 0 on, one plane for each byte of the largest value, compressed."""
    planes = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    wide = x.astype("<u4" if planes <= 4 else "<u8", copy=False)
    raw = np.ascontiguousarray(wide).view(np.uint8).reshape(len(x), wide.itemsize)
    c = zstandard.ZstdCompressor(level=3).compressobj(size=planes * len(x))
    return b"".join([bytes([planes]), *(c.compress(np.ascontiguousarray(raw[:, p])) for p in range(planes)), c.flush()])


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(b[0], -1)
    kind = np.int32 if b[0] < 4 else np.int64
    out = planes[0].astype(kind)
    for p in range(1, b[0]):
        out |= planes[p].astype(kind) << kind(8 * p)
    return out


def pack_words(data, at) -> bytes:
    sizes = pack(np.diff(at))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(data))


def unpack_words(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(b[:4], "little")
    sizes = unpack(b[4 : 4 + n])
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b[4 + n :]), np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def gather(data, at, index):
    """The segments data[at[i]:at[i+1]] for i in index, end to end, and their offsets."""
    size = np.diff(at)[index]
    out = np.concatenate(([0], np.cumsum(size)))
    return data[np.arange(out[-1]) + np.repeat(at[:-1][index] - out[:-1], size)], out


def segments(data, sizes) -> pa.Array:
    """The bytes as an array of segments of these sizes, with narrow offsets where they fit."""
    small = len(data) < 1 << 31
    at = np.zeros(len(sizes) + 1, np.int32 if small else np.int64)
    np.cumsum(sizes, out=at[1:])
    return pa.Array.from_buffers(pa.binary() if small else pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(data)])


def split(batches, tokens, extra, keyed, parts: int, limit: int):
    """Blocks of the batches as packed rows. tokens(record batch) yields (carried, data, at) for runs of rows: the
    bytes and offsets of their tokens, and what finish() needs of these rows. extra(carried list, numbers, n distinct):
    an integer for each distinct word that its part gets, or None. keyed(carried list, parts): (carried list, (part, bytes)
    rows) of what the block asks besides its words; such parts are numbered from `parts` on."""
    task = TaskContext.get()
    block = (task.partitionId() if task else 0) << 32

    def rows(held):
        nonlocal block
        carried = [c for c, _, _ in held]
        data, sizes = np.concatenate([d for _, d, _ in held]), np.concatenate([z for _, _, z in held])
        held.clear()
        coded = segments(data, sizes).dictionary_encode()
        number, (data, at) = coded.indices.to_numpy(zero_copy_only=False), utf8(coded.dictionary)
        del coded, sizes
        h = np.zeros(len(at) - 1, np.uint64)
        full = np.diff(at) > 0
        if full.any():
            h[full] = hashes(data, np.append(at[:-1][full], at[-1]))
        to = (h % np.uint64(parts)).astype(np.int32)
        ranked = np.argsort(-np.bincount(number, minlength=len(to)), kind="stable")  # small numbers for frequent words pack best
        rank = np.empty(len(ranked), np.int32)
        rank[ranked] = np.arange(len(ranked), dtype=np.int32)
        order = ranked[np.argsort(to[ranked], kind="stable")]
        add = extra(carried, number, len(order)) if extra else None
        out = {k: [] for k in NAMES}
        ends = np.searchsorted(to[order], np.arange(parts + 1))
        sizes = np.diff(ends)
        for p in np.flatnonzero(sizes).tolist():
            mine = order[ends[p] : ends[p + 1]]
            for k, v in zip(out, (block, p, pack_words(*gather(data, at, mine)), pack(add[mine]) if add is not None else None, None), strict=True):
                out[k].append(v)
        if keyed:
            carried, asked = keyed(carried, parts)
            for p, sent in asked:
                for k, v in zip(out, (block, parts + p, None, sent, None), strict=True):
                    out[k].append(v)
        body = pickle.dumps((carried, pack(rank[number]), pack(to[ranked])), protocol=5)
        for k, v in zip(out, (block, -1 - block % parts, None, None, body), strict=True):
            out[k].append(v)
        block += 1
        yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(NAMES, KINDS, strict=True)], names=NAMES)

    held, size = [], 0
    for batch in batches:
        for carried, data, at in tokens(batch):
            held.append((carried, data, np.diff(at).astype(np.int32)))
            size += len(data)
            if size >= limit:
                yield from rows(held)
                size = 0
    if held:
        yield from rows(held)


def _rows(batches):
    """The rows one by one: a batch of packed words becomes Python objects a row at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _groups(rows, of):
    """Runs of rows of equal of(row)."""
    held = []
    for row in rows:
        if held and of(held[0]) != of(row):
            yield held
            held = []
        held.append(row)
    if held:
        yield held


class Part:
    """The words that blocks sent to a part, unpacked as they are read, any number of times: (data, at, sent)."""

    def __init__(self, rows):
        self.rows = rows

    def __iter__(self):
        for _, _, w, s, _ in self.rows:
            yield *unpack_words(w), unpack(s) if s is not None else None


def resolve(batches, answer, answer_keys, parts: int):
    """Rows of one or more whole parts, sorted by part: answer(Part) and answer_keys([sent]) yield bytes for each row."""
    for rows in _groups(_rows(batches), lambda r: r[1]):
        if rows[0][1] >= 0:
            got = answer(Part(rows)) if rows[0][1] < parts else answer_keys([r[3] for r in rows])
            rows = (r[:2] + (None, x, None) for r, x in zip(rows, got, strict=True))
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, KINDS, strict=True)], names=NAMES)


def finish(batches, put, parts: int):
    """Rows of whole blocks, sorted by block and part, the body first: put(carried, number, [answers by part], [answers to
    keys]) yields record batches."""
    for rows in _groups(_rows(batches), lambda r: r[0]):
        carried, number, to = pickle.loads(rows[0][4])
        answers, keys = [r[3] for r in rows[1:] if r[1] < parts], [r[3] for r in rows[1:] if r[1] >= parts]
        rows.clear()
        order = np.argsort(unpack(to), kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        yield from put(carried, place[unpack(number)], answers, keys)


def by_distinct_word(df: DataFrame, tokens, answer, put, schema: str, n: int, extra=None, keyed=None, answer_keys=None) -> DataFrame:
    """The three steps over df: two shuffles of packed words and of positions, none of texts.

    n is the number of partitions of both. Blocks are made once and pass both shuffles, so a lost task is computed again
    from shuffled rows or from the scan and gives the same rows.
    """
    parts, limit = min(4 * n, MOST_PARTS), BLOCK
    cut = per_batch(df, lambda it: split(it, tokens, extra, keyed, parts, limit), ROWS)
    asked = cut.repartition(n, F.col("part")).sortWithinPartitions("part", "block")
    got = per_batch(asked, lambda it: resolve(it, answer, answer_keys, parts), ROWS)
    back = got.repartition(n, F.col("block")).sortWithinPartitions("block", "part")
    return per_batch(back, lambda it: finish(it, put, parts), schema)
