"""Byte-level BPE: a global distinct-word shuffle encodes, a join with the token-byte table decodes.

encode(): pre-tokens of whole texts are found by array operations over code points (the split pattern of the public
byte-level vocabularies), each distinct pre-token of the corpus is merged once in the part it hashes to, and the ids
return to the positions of the block (see distinct.py). decode(): ids index the table of token bytes.

Defined cases: a null or empty text has no ids; texts of any length are one unit; a null doc_id and repeated rows are
kept, one result for each row; an empty table gives no rows; other columns are ignored. An id outside the vocabulary
makes decode() fail rather than drop bytes; null ids decode to null.
"""

import base64
import hashlib
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .distinct import by_distinct_word, gather, pack, unpack
from .spans import binary, chunks, code_points, utf8
from .workspace import partitions, per_batch

# Unicode White_Space outside ASCII letters' reach, and the contractions of the pattern.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT, LONG = "stmd", ("re", "ve", "ll")

GAP, BLANK, LETTER, NUMBER, OTHER = range(5)

#: Words of a part whose ids are remembered; texts of many distinct words are merged again beyond it.
MEMO = 1_000_000
#: Bytes of decimal ids or of text that are put together at a time for the digests, but for a longer text alone.
STEP = 2 << 20


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point: white space, the space itself, letter (L*), number (N*), or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = GAP
    out[0x20] = BLANK
    return out


def pretokens(buf, offsets) -> np.ndarray:
    """Byte offsets at which the pre-tokens of the rows start, and the end."""
    if not len(buf):
        return np.zeros(1, np.int64)
    at, point = code_points(buf)
    kind = _classes()[point]
    n = len(kind)
    new = np.zeros(n + 1, bool)
    new[np.searchsorted(at, offsets)] = True
    new[0] = new[n] = True
    white = kind <= BLANK
    before, after = np.empty(n, np.uint8), np.empty(n, bool)
    before[0], before[1:] = GAP, kind[:-1]
    after[-1], after[:-1] = False, ~white[1:] & ~new[1:n]
    start = new[:n] | np.where(white, (before > BLANK) | after, np.where(before <= BLANK, before == GAP, before != kind))
    quote = np.flatnonzero((point == 0x27) & start)
    if len(quote):
        p = np.append(point, [0, 0, 0])
        stop = np.append(new, [True, True, True])
        in1 = ~stop[quote + 1]
        in2 = in1 & ~stop[quote + 2]
        short = in1 & np.isin(p[quote + 1], [ord(c) for c in SHORT])
        long = np.zeros(len(quote), bool)
        for pair in LONG:
            long |= in2 & (p[quote + 1] == ord(pair[0])) & (p[quote + 2] == ord(pair[1]))
        for found, size in ((quote[short], 2), (quote[long], 3)):
            start[found + 1] = False
            start[(found + size)[found + size < n]] = True
    return np.append(at[start], len(buf))


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("scholion", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(2)
def _token_bytes(path: str) -> pa.Array:
    table = ranks(path)
    out = [None] * (max(table.values()) + 1)
    for token, i in table.items():
        out[i] = token
    return pa.array(out, pa.large_binary())


def encode(df: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, ids array<int>) for each row of df."""

    def tokens(batch):
        buf, offsets = utf8(batch.column(1))
        for lo, hi, b, o in chunks(buf, offsets):
            at = pretokens(b, o)
            yield (pa.array(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(0).type), np.diff(np.searchsorted(at[:-1], o))), b, at

    def answer(part):
        merge, memo = _encoder(path)._encode_single_piece, {}
        for data, at, _ in part:
            sizes, flat = [], []
            for w in binary(data, at).to_pylist():
                got = memo.get(w)
                if got is None:
                    got = memo[w] = merge(w)
                sizes.append(len(got))
                flat += got
            if len(memo) > MEMO:
                memo.clear()
            sizes = pack(np.array(sizes, np.int32))
            yield len(sizes).to_bytes(4, "little") + sizes + pack(np.array(flat, np.int32))

    def put(carried, number, answers, _):
        sizes, flat = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for b in answers:
            n = int.from_bytes(b[:4], "little")
            sizes.append(unpack(b[4 : 4 + n]))
            flat.append(unpack(b[4 + n :]))
        at, flat, done = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), np.concatenate(flat).astype(np.int32, copy=False), 0
        for docs, counts in carried:
            ids, ends = gather(flat, at, number[done : done + int(counts.sum())])
            done += int(counts.sum())
            edge = ends[np.concatenate(([0], np.cumsum(counts)))]
            yield pa.RecordBatch.from_arrays([docs, pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids))], names=[doc, "ids"])

    rows = df.select(doc, text)
    kind = rows.schema[doc].dataType.simpleString()
    return by_distinct_word(rows, tokens, answer, put, f"`{doc}` {kind}, ids array<int>", partitions(rows))


def _flat(column):
    """Values and int64 offsets of a list column; null lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(column), np.concatenate(([0], np.cumsum(sizes)))


def _taken(table: pa.Array, ids, edges):
    """The bytes of the table's entries of each list of ids."""
    if len(ids) and (pc.min(ids).as_py() < 0 or pc.max(ids).as_py() >= len(table)):
        raise ValueError("an id is not in the vocabulary")
    got = table.take(ids)
    if got.null_count:
        raise ValueError("an id is not in the vocabulary")
    data, at = utf8(got)
    return data, at[edges]


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the bytes of the ids in a binary column."""
    names = df.columns

    def run(batches):
        for batch in batches:
            column = batch.column(names.index(ids))
            data, edge = _taken(_token_bytes(path), *_flat(column))
            raw = data.tobytes()
            got = [raw[a:b] if ok else None for a, b, ok in zip(edge[:-1].tolist(), edge[1:].tolist(), column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*names, to])

    return per_batch(df, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{to}` binary")


def digests(df: DataFrame, path: str, doc: str = "doc_id") -> DataFrame:
    """(doc, n_tokens, ids_sha256, decoded_sha256) of encoded rows: the ids as decimal text with commas, and the bytes
    that they decode to by the token-byte table."""

    def run(batches):
        table = _token_bytes(path)
        decimal = pa.array([b"%d," % i for i in range(len(table))], pa.large_binary())
        for batch in batches:
            _, ends = _flat(batch.column(1))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + STEP // 6, "right")) - 1)  # six bytes an id at most
                part = batch.slice(lo, hi - lo)
                lo = hi
                flat, edges = _flat(part.column(1))
                out = []
                for source, tail in ((decimal, 1), (table, 0)):
                    data, at = _taken(source, flat, edges)
                    view = memoryview(np.ascontiguousarray(data))
                    out.append([hashlib.sha256(view[a : max(a, b - tail)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(edges), pa.int64()), *map(pa.array, out)], names=[doc, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(doc, "ids")
    kind = rows.schema[doc].dataType.simpleString()
    return per_batch(rows, run, f"`{doc}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
