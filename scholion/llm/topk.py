"""Exact top-k inner products over a bit-sliced index.

Vectors become integers floor(scale x). A block of rows keeps, for every attribute, one bitmap for each bit of its
value above the block's minimum, and of its distance from the maximum (for negative query weights). A query's score is a
sum of shifted bitmaps: all bitmaps of equal weight are added by carry-save adders, column by column, which leaves the
slices of the score. Products below 2^drop are left out, which bounds the error; the k-th score is found from the most
significant slice downward, every row that the error could lift over it is compared, and those rows are resolved by
exact integer products, ties to the smaller id.

Queries and rows are dealt over (block of rows, group of queries) pairs, so neither side is broadcast, and each pair
returns k rows a query at most. Repeated rows are counted before, and at most k copies of one are dealt, since no more of
them can be among the k.

Defined cases: rows whose id or vector is null, or whose vector holds null, NaN or an infinity, take no part; vectors
meet only vectors of their own length; a query is compared with all rows of another id; repeated rows are candidates
each, equal repeated queries are one; with fewer than k candidates all are returned; an empty table gives no rows; other
columns are ignored. Scores must fit 63 bits: a component of 2^31 / sqrt(length) or more, after scaling, is an error.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import per_batch, table


def bitmap(bits: np.ndarray) -> np.ndarray:
    """Packed 64-bit words of a boolean row or rows; the length must be a multiple of 64."""
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


class Slices:
    """The index of one block: rows x attributes of integers."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        n, width = rows.shape
        room = -(-n // 64) * 64
        self.low, self.high = rows.min(0), rows.max(0)
        self.bits = [int(x).bit_length() for x in (self.high - self.low).tolist()]
        self.up, self.down = [], []
        for d in range(width):
            for out, value in ((self.up, rows[:, d] - self.low[d]), (self.down, self.high[d] - rows[:, d])):
                bits = np.zeros((self.bits[d], room), bool)
                for j in range(self.bits[d]):
                    bits[j, :n] = (value >> j) & 1
                out.append(bitmap(bits) if self.bits[d] else np.zeros((0, room // 64), np.uint64))
        every = np.zeros(room, bool)
        every[:n] = True
        self.every = bitmap(every)

    def sums(self, query: np.ndarray, drop: int):
        """(slices from the least weight 2^drop up, what the left-out products sum to at most, the constant part)."""
        columns, error, base = {}, 0, 0
        for d, q in enumerate(query.tolist()):
            side, base = (self.up[d], base + q * int(self.low[d])) if q > 0 else (self.down[d], base + q * int(self.high[d]))
            for i in range(abs(q).bit_length()):
                if abs(q) >> i & 1:
                    cut = min(max(0, drop - i), self.bits[d])
                    error += ((1 << cut) - 1) << i
                    for j in range(cut, self.bits[d]):
                        columns.setdefault(i + j, []).append(side[j])
        out, w = [], drop
        while columns and w <= max(columns):
            column = np.array(columns.pop(w, []), np.uint64).reshape(-1, len(self.every))
            carries = []
            while len(column) > 1:
                m = len(column) // 3
                if m:
                    a, b, c = column[: 3 * m : 3], column[1 : 3 * m : 3], column[2 : 3 * m : 3]
                    half = a ^ b
                    carries.append((a & b) | (half & c))
                    column = np.concatenate((half ^ c, column[3 * m :]))
                else:
                    carries.append(column[:1] & column[1:])
                    column = column[:1] ^ column[1:]
            out.append(column[0] if len(column) else np.zeros_like(self.every))
            if carries:
                columns.setdefault(w + 1, []).extend(np.concatenate(carries))
            w += 1
        return out, error, base

    def nearest(self, own, query: np.ndarray, k: int, drop: int = 4):
        """(ids, scores) of the k rows of another id with the largest products with the query."""
        among = self.every.copy()
        for r in np.flatnonzero(self.ids == own).tolist():
            among[r // 64] &= ~np.uint64(1 << (r % 64))
        slices, error, _ = self.sums(query, drop)
        sure, equal, kth = np.zeros_like(among), among.copy(), 0
        k_here = min(k, int(np.bitwise_count(among).sum()))
        if not k_here:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        for w in range(len(slices) - 1, -1, -1):
            more = sure | (equal & slices[w])
            if int(np.bitwise_count(more).sum()) >= k_here:
                equal &= slices[w]
                kth |= 1 << w
            else:
                sure = more
                equal &= ~slices[w]
        least = kth - -(-error // (1 << drop))  # in units of 2^drop; rows below cannot reach the k-th
        over, level = np.zeros_like(among), among.copy()
        for w in range(len(slices) - 1, -1, -1) if least > 0 else ():
            if least >> w & 1:
                level &= slices[w]
            else:
                over |= level & slices[w]
                level &= ~slices[w]
        rows = np.flatnonzero(np.unpackbits((over | level).view(np.uint8), bitorder="little"))
        scores = self.rows[rows] @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]


def top(df: DataFrame, every: int = 50, k: int = 5, scale: int = 256, block: int = 8192, group: int = 4096, vec: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for each query, a row whose id is divisible by `every`."""
    fine = F.expr(f"`{vec}` is not null and `{vector}` is not null and forall(`{vector}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    large = f"exists(`{vector}`, x -> abs({scale} * cast(x as double)) * sqrt(size(`{vector}`)) >= 2147483648e0)"
    whole = F.expr(f"if({large}, raise_error('a vector is too large for 63-bit scores'), transform(`{vector}`, x -> cast(floor({scale} * cast(x as double)) as bigint)))")
    every_row = df.select(vec, vector).where(F.coalesce(fine, F.lit(False))).select(F.col(vec).cast("bigint").alias("id"), whole.alias("v")).withColumn("dim", F.size("v"))
    rows = table(every_row.groupBy("id", "dim", "v").agg(F.count("*").alias("copies")), "vectors")
    n = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q")).first()
    blocks, groups = max(1, -(-n.n // block)), max(1, -(-n.q // group))
    spread = F.xxhash64("id", "v")
    candidates = rows.select("dim", F.pmod(spread, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(0).alias("kind"), "id", "v", F.least("copies", F.lit(k)).cast("int").alias("copies"))
    asked = rows.where(F.col("id") % every == 0).select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(spread, F.lit(groups)).cast("int").alias("grp"), F.lit(1).alias("kind"), "id", "v", F.lit(1).alias("copies"))
    width = max(blocks * groups, 1)
    dealt = candidates.unionByName(asked).repartition(min(width, 100_000), "dim", "block", "grp").sortWithinPartitions("dim", "block", "grp", "kind", "id")

    def run(batches):
        at, ids, vectors, index = None, [], [], None
        for batch in batches:
            dim, b, g, kind, own, copies = (batch.column(i).to_numpy() for i in (0, 1, 2, 3, 4, 6))
            flat, ends = batch.column(5).flatten().to_numpy(), np.concatenate(([0], np.cumsum(dim)))
            cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in (dim, b, g, kind)], axis=0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                here = (int(dim[lo]), int(b[lo]), int(g[lo]))
                if here != at:
                    at, ids, vectors, index = here, [], [], None
                rows = flat[ends[lo] : ends[hi]].reshape(hi - lo, here[0])
                if kind[lo] == 0:
                    ids.append(np.repeat(own[lo:hi], copies[lo:hi]))
                    vectors.append(np.repeat(rows, copies[lo:hi], axis=0))
                    continue
                if ids and index is None:
                    index = Slices(np.concatenate(ids), np.concatenate(vectors))
                for query, v in zip(own[lo:hi].tolist(), rows, strict=True) if ids else ():
                    found, scores = index.nearest(query, v, k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), query)), pa.array(np.full(len(found), zlib.crc32(v.tobytes()))), pa.array(found), pa.array(scores)], names=["query_id", "query", "vec_id", "score"])

    # a query id of two vectors is two queries, told apart by a checksum of the vector
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    got = per_batch(dealt, run, "query_id bigint, query bigint, vec_id bigint, score bigint")
    return got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
