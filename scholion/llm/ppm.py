"""Language-model scores by partial matching over a byte-context trie, beside an add-one word baseline.

The model is pretrained on the training rows: every byte with its four bytes of context is a path of the trie, stored as
the counts of its five-byte grams (shorter contexts are sums of these; a text begins with four START bytes and ends with
an END byte, neither of which UTF-8 has). A byte's probability is method C: a context of total n with d distinct followers
gives a follower of count c the share c / (n + d) and leaves d / (n + d) to the next shorter context, in which all
followers of the longer one are excluded from counts and totals; below the empty context the rest is uniform.

A byte's probability depends on its gram alone, so it is computed once for each distinct gram. A block of texts sends its
distinct grams and their training counts to parts by the three nearest context bytes, where equal grams of all blocks and
all followers of the two longest contexts meet; totals of shorter contexts are broadcast (at most 2^24 rows by
construction, packed). The answers return to the block and are looked up there, so the model is nowhere held as a whole
and grows with the corpus; one path serves every size.

The baseline counts training words by the global distinct-word shuffle of distinct.py, of which the grams are a second
channel; texts travel compressed in the body of their block.

Defined cases: a null or empty text is scored as END alone; a null doc_id is a training row (it has no fold); repeated
rows are scored and counted each; an empty table gives no rows; without training rows every byte is uniform; other
columns are ignored.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .distinct import by_distinct_word, pack, unpack
from .folds import folds
from .spans import binary, chunks, utf8, words
from .workspace import partitions, per_batch, table

ORDER = 4
START, END = 0xFE, 0xFF
#: The three last bytes of a gram.
LOW = 0xFFFFFF


def grams(buf, offsets):
    """(gram code of every byte and of END, offsets of the rows in them)."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    text = np.full(len(buf) + n * (ORDER + 1), START, np.uint8)
    text[np.arange(len(buf)) + np.repeat(np.arange(n) * (ORDER + 1) + ORDER, sizes)] = buf
    ends = np.cumsum(sizes + ORDER + 1)
    text[ends - 1] = END
    code = np.zeros(len(text) - ORDER, np.uint64) if n else np.zeros(0, np.uint64)
    for j in range(ORDER + 1 if n else 0):
        code = (code << np.uint64(8)) | text[j : len(text) - ORDER + j]
    return code[text[ORDER:] != START] if n else code, np.concatenate(([0], np.cumsum(sizes + 1)))


def _summed(kept):
    """Distinct codes and the sums of their counts of (codes, counts) pairs."""
    u, at = np.unique(np.concatenate([a for a, _ in kept]), return_inverse=True)
    return u, np.bincount(at, np.concatenate([b for _, b in kept]), len(u)).astype(np.int64)


def low_counts(df: DataFrame, hold, doc: str, text: str):
    """(codes, counts): every three-byte gram of the training rows, in order. At most 2^24, and sent in packed rows."""

    def run(batches):
        kept, size = [], 0
        for batch in batches:
            trains = ~hold(batch.column(0).to_pylist())
            buf, offsets = utf8(batch.column(1))
            for lo, hi, b, o in chunks(buf, offsets):
                code, at = grams(b, o)
                u, n = np.unique((code[np.repeat(trains[lo:hi], np.diff(at))] & np.uint64(LOW)).astype(np.uint32), return_counts=True)
                kept.append((u, n))
                size += len(u)
                if size > 1 << 20:
                    kept = [_summed(kept)]
                    size = len(kept[0][0])
        if kept:
            u, n = _summed(kept)
            for lo in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[lo : lo + 100_000].astype(np.int64)), pa.array(n[lo : lo + 100_000])], names=["gram", "n"])

    def packed(batches):
        rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if rows:
            u, n = (np.concatenate(x) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([pack(u)], pa.binary()), pa.array([pack(n)], pa.binary())], names=["gram", "n"])

    sums = per_batch(df.select(doc, text), run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    got = [(unpack(bytes(r.gram)).astype(np.int64), unpack(bytes(r.n)).astype(np.int64)) for r in per_batch(sums, packed, "gram binary, n binary").toLocalIterator()]
    return _summed(got) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _tallies(code, n):
    """Grams with a count, and of their contexts: (grams, counts, contexts, totals, distinct followers)."""
    g, at = np.unique(code[n > 0], return_inverse=True)
    c = np.bincount(at, n[n > 0], len(g)) if len(g) else np.zeros(0)
    x, at = np.unique(g >> 8, return_inverse=True)
    return g, c, x, np.bincount(at, c, len(x)) if len(x) else np.zeros(0), np.bincount(at, minlength=len(x)).astype(float) if len(x) else np.zeros(0)


def _find(keys, values, x):
    """values where keys (sorted) hold x, else 0."""
    if not len(keys):
        return np.zeros(len(x))
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, values[at], 0.0)


def log_probabilities(code: np.ndarray, n: np.ndarray, low_code: np.ndarray, low_n: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of every gram. code, n: grams and training counts, all those of each three
    nearest context bytes; low_code, low_n: counts of all three-byte grams of the corpus."""
    code = code.astype(np.int64)
    levels = {}
    for j in range(ORDER, -1, -1):
        mask = (1 << (8 * (j + 1))) - 1
        levels[j] = _tallies(code & mask, n) if j > 2 else _tallies(low_code.astype(np.int64) & mask, low_n)
    out, done = np.zeros(len(code)), np.zeros(len(code), bool)
    for j in range(ORDER, -1, -1):
        g, c, x, total, followers = levels[j]
        mask = (1 << (8 * (j + 1))) - 1
        own = code & mask
        context = own >> 8
        sum_, kinds = _find(x, total, context), _find(x, followers, context)
        if j < ORDER:
            longer = (code & ((1 << (8 * (j + 2))) - 1)) >> 8
            g1, _, x1, _, followers1 = levels[j + 1]
            seen = _find(g, c, g1 & mask)
            at = np.searchsorted(x1, g1 >> 8)
            sum_ = sum_ - _find(x1, np.bincount(at, seen, len(x1)) if len(x1) else seen, longer)
            kinds = kinds - _find(x1, followers1, longer)
        left = ~done & (kinds > 0)
        count = _find(g, c, own)
        hit = left & (count > 0)
        whole = np.where(left, sum_ + kinds, 1.0)
        out[hit] += np.log10(count[hit] / whole[hit])
        miss = left & ~hit
        out[miss] += np.log10(kinds[miss] / whole[miss])
        done |= hit
    rest = max(1.0, 256.0 - len(levels[0][0]))
    out[~done] -= np.log10(rest)
    return out


SPREAD = np.uint64(0x9E3779B97F4A7C15)


def hash_table(keys: np.ndarray, values: np.ndarray):
    """An open-addressing table of at least twice as many slots as keys."""
    bits = max(4, int(2 * len(keys)).bit_length())
    slots, held = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << bits)
    keys = keys.astype(np.uint64)
    left, at = np.arange(len(keys)), (keys * SPREAD) >> np.uint64(64 - bits)
    while len(left):
        free = slots[at] == np.iinfo(np.uint64).max
        mine, first = np.unique(at[free], return_index=True)
        who = left[free][first]
        slots[mine], held[mine] = keys[who], values[who]
        stay = np.ones(len(left), bool)
        stay[np.flatnonzero(free)[first]] = False
        left, at = left[stay], (at[stay] + np.uint64(1)) & np.uint64((1 << bits) - 1)
    return slots, held


def look_up(slots, held, keys):
    bits = len(slots).bit_length() - 1
    at = (keys * SPREAD) >> np.uint64(64 - bits)
    wrong = np.flatnonzero(slots[at] != keys)
    while len(wrong):
        at[wrong] = (at[wrong] + np.uint64(1)) & np.uint64((1 << bits) - 1)
        if (slots[at[wrong]] == np.iinfo(np.uint64).max).any():
            raise KeyError("a gram is not in the block's answers")
        wrong = wrong[slots[at[wrong]] != keys[wrong]]
    return held[at]


def asked(code, n, parts: int):
    """(part, packed request) rows of a block's distinct grams in order of part: codes, less the smallest, and counts."""
    near = ((code >> np.uint64(8)) & np.uint64(LOW)).astype(np.uint64)
    to = ((near * SPREAD) >> np.uint64(32)) % np.uint64(parts)
    order = np.argsort(to, kind="stable")
    code, n, to = code[order], n[order], to[order]
    ends = np.searchsorted(to, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(ends)).tolist():
        a, b = int(ends[p]), int(ends[p + 1])
        steps = pack(np.diff(code[a:b], prepend=np.uint64(0)))
        yield p, len(steps).to_bytes(4, "little") + steps + pack(n[a:b])


def request(b: bytes):
    """The codes and counts of a packed request."""
    size = int.from_bytes(b[:4], "little")
    return np.cumsum(unpack(b[4 : 4 + size]).astype(np.int64)), unpack(b[4 + size :]).astype(np.int64)


def answered(b: bytes):
    """The codes of a request and their log probabilities."""
    size = int.from_bytes(b[:4], "little")
    return np.cumsum(unpack(b[4 : 4 + size]).astype(np.int64)), np.frombuffer(b, np.float64, offset=4 + size)


def score(df: DataFrame, fold: int = 7, held: int = 2, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; trained on the rows of other folds."""
    spark = df.sparkSession

    def hold(ids):
        return folds(ids, fold) == held

    rows = df.select(doc, text)
    low = spark.sparkContext.broadcast(low_counts(rows, hold, doc, text))

    def tokens(batch):
        buf, offsets = utf8(batch.column(1))
        ids = batch.column(0).to_pylist()
        out = hold(ids)
        for lo, hi, b, o in chunks(buf, offsets):
            data, at, first = words(b, o)
            sizes = np.insert(np.diff(at), first[1:], 0)  # each text's words, then the empty word for its end
            yield (ids[lo:hi], out[lo:hi], np.diff(first) + 1, b, o), data, np.concatenate(([0], np.cumsum(sizes)))

    def keyed(carried, parts):
        kept, size, sealed = [], 0, []
        for ids, out, sizes, b, o in carried:
            code, at = grams(b, o)
            train = np.repeat(~out, np.diff(at))
            u, where = np.unique(code, return_inverse=True)
            kept.append((u, np.bincount(where, train, len(u))))
            size += len(u)
            if size > 1 << 20:
                kept = [_summed(kept)]
                size = len(kept[0][0])
            sealed.append((ids, out, sizes, zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(b)), o))
        return sealed, asked(*_summed(kept), parts)

    def answer_keys(requests):
        own = [request(b) for b in requests]
        code, n = _summed(own)
        logs = log_probabilities(code, n, *low.value)
        for b, (u, _) in zip(requests, own, strict=True):
            yield b[: 4 + int.from_bytes(b[:4], "little")] + logs[np.searchsorted(code, u)].tobytes()

    def extra(carried, number, n):
        train = np.concatenate([np.repeat(~c[1], c[2]) for c in carried])
        return np.bincount(number[train], minlength=n)

    def answer(part):
        counts = {}
        for data, at, sent in part:
            for w, n in zip(binary(data, at).to_pylist(), sent.tolist(), strict=True):
                counts[w] = counts.get(w, 0) + n
        for data, at, _ in part:  # the first block that has a training word counts it for the vocabulary
            ws, own = binary(data, at).to_pylist(), 0
            out = pack(np.array([abs(counts[w]) for w in ws], np.int64))
            for w in ws:
                if counts[w] > 0:
                    counts[w] = -counts[w]
                    own += 1
            yield own.to_bytes(4, "little") + out

    def put(carried, number, answers, keys):
        c = np.concatenate([np.zeros(0, np.int64), *(unpack(b[4:]) for b in answers)])[number]
        own, done = sum(int.from_bytes(b[:4], "little") for b in answers), 0
        table_ = hash_table(*(np.concatenate(x) for x in zip(*map(answered, keys), strict=True)))
        for ids, out, sizes, z, o in carried:
            g, edge = grams(np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8), o)
            sums = np.add.reduceat(look_up(*table_, g), edge[:-1])
            at = done + np.concatenate(([0], np.cumsum(sizes)))[:-1]
            mine = c[done : done + int(sizes.sum())]
            known, logs = np.add.reduceat((mine > 0).astype(np.int64), at - done), np.add.reduceat(np.log10(mine + 1.0), at - done)
            first = np.zeros(len(ids), np.int64)
            first[0], own = own, 0
            done += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(out), pa.array(sizes, pa.int64()), pa.array(known), pa.array(logs), pa.array(first), pa.array(sums)], names=[doc, "held_out", "n_tokens", "n_known", "logs", "vocabulary", "score"])

    kind = to_arrow_type(rows.schema[doc].dataType)
    schema = f"`{doc}` {rows.schema[doc].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, logs double, vocabulary bigint, score double"
    done = table(by_distinct_word(rows, tokens, answer, put, schema, partitions(rows), extra, keyed, answer_keys), "scores")
    low.destroy()
    whole = done.agg(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))).alias("n"), F.sum("vocabulary").alias("v")).first()
    n, v = whole.n or 0, whole.v or 0
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return done.select(doc, "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")
