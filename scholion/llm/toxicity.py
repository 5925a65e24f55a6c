"""Toxicity by nearest labelled examples: exact TF-IDF cosine through a block-max inverted index.

Examples are a bounded sample of the labelled training rows, `examples` of each label, none longer than `longest` characters
(bounds of the model). Terms are the stems of the examples' words, all of them: a word cut to its first STEM letters, which
gathers the forms of an inflected word. Vectors are (1 + ln tf) idf, of length 1, with the document frequency counted over
all documents: idf = ln(1 + N / (df + SMOOTH N)) ^ POWER, so that stems seen in few texts do not outweigh all others, nor
the many common ones the rest. Words of no example's stem are no terms.

The index holds postings by term and block of examples, and the largest weight of each term in each block; lists of terms
that a share COMMON of the examples hold stand in full, and many queries are multiplied with them at once. What these give
and the maxima of the other terms bound a query's cosine with every block: it evaluates the blocks of the largest bounds,
and then those whose bound reaches the k-th best found, so the k neighbours are exact. Votes are weighted by 1 / (distance + 0.05); the votes of the examples
among each other, weighted back to the label shares of all labelled rows, are fitted by a monotone function, which makes
the vote a probability.

Defined cases: null and empty texts, and texts without any term, have no neighbour and the examples' share of toxic rows as
score; equally near examples rank by doc_id; label rows with null doc_id or label teach nothing, nor do documents without
an id; of documents that repeat an id the least text teaches; without both labels every score is 0; a null doc_id is not
held out; repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .folds import fold as fold_of
from .folds import folds, sample
from .spans import MARKS, chunks, hashes, utf8, words
from .workspace import per_batch

STEM = 4
SMOOTH, POWER = 0.01, 2
#: Examples in a block, and blocks that a query evaluates first; share of the examples whose lists stand in full.
BLOCK, FIRST, COMMON = 32, 8, 0.04
#: Rows that the document frequencies are summed in.
SLICES = 16


def stems(buf, offsets):
    """(row, hash of the stem) of every word."""
    data, at, first = words(buf, offsets, gaps=MARKS)
    lead = (data & 0xC0) != 0x80
    place = np.cumsum(lead)
    size = np.diff(at)
    kept = place - np.repeat(place[at[:-1]] if len(size) else place[:0], size) < STEM
    edge = np.concatenate(([0], np.cumsum(kept)))[at]
    return np.repeat(np.arange(len(offsets) - 1), np.diff(first)), hashes(data[kept], edge)


def of_terms(buf, offsets, known):
    """For each row (term numbers in order, counts); known: the terms' hashes in order."""
    row, h = stems(buf, offsets)
    if not len(known):
        row, h = row[:0], h[:0]
    t = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    there = known[t] == h
    pair, n = np.unique(row[there] * max(1, len(known)) + t[there], return_counts=True)
    row, t = pair // max(1, len(known)), pair % max(1, len(known))
    edge = np.searchsorted(row, np.arange(len(offsets)))
    return [(t[a:b], n[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def clustered(vectors, terms: int, pivots: int = 48) -> np.ndarray:
    """An order of the vectors in which alike ones are neighbours, which makes the blocks' maxima tight: by the pivot they
    are nearest to, then by their number of terms."""
    n = len(vectors)
    dense = np.zeros((terms, min(pivots, n)))
    for j, i in enumerate(np.linspace(0, n - 1, min(pivots, n)).astype(int).tolist()):
        dense[vectors[i][0], j] = vectors[i][1]
    nearest = [int(np.argmax(w @ dense[t])) if len(t) else 0 for t, w in vectors]
    return np.lexsort(([len(t) for t, _ in vectors], nearest)) if n else np.zeros(0, np.int64)


class Index:
    """Postings of unit vectors by term and block, and the largest weight of every term in every block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK):
        self.n, self.block = len(vectors), block
        self.blocks = max(1, -(-self.n // block))
        self.order = clustered(vectors, terms)  # the vector that stands at each place
        self.place = np.empty(self.n, np.int64)
        self.place[self.order] = np.arange(self.n)
        held = [vectors[i] for i in self.order.tolist()]
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in held)])
        weight = np.concatenate([np.zeros(0), *(w for _, w in held)])
        at = np.repeat(np.arange(self.n), [len(t) for t, _ in held])
        common = np.flatnonzero(np.bincount(term, minlength=terms) > COMMON * self.n)
        self.row = np.full(terms, -1)
        self.row[common] = np.arange(len(common))
        full = self.row[term] >= 0
        self.full = np.zeros((len(common), self.n))
        self.full[self.row[term[full]], at[full]] = weight[full]
        by = np.flatnonzero(~full)
        by = by[np.argsort(term[by], kind="stable")]
        self.at, self.weight = at[by].astype(np.int32), weight[by]
        cell = term[by] * self.blocks + self.at // block
        self.start = np.searchsorted(cell, np.arange(terms * self.blocks + 1)).astype(np.int32)
        self.most = np.zeros(terms * self.blocks, np.float32)
        if len(cell):
            head = np.flatnonzero(np.diff(cell, prepend=-1))
            self.most[cell[head]] = np.nextafter(np.maximum.reduceat(self.weight, head).astype(np.float32), np.float32(2))
        self.most = self.most.reshape(terms, self.blocks)

    def _sums(self, t, w, blocks) -> np.ndarray:
        """What the postings of some blocks add to the products, by place."""
        blocks = np.sort(blocks)
        cut = np.flatnonzero(np.diff(blocks) > 1) + 1
        lo, hi = blocks[np.concatenate(([0], cut))], blocks[np.concatenate((cut - 1, [len(blocks) - 1]))] + 1
        base = (t * self.blocks)[:, None]
        a = self.start[(base + lo).ravel()].astype(np.int64)
        size = self.start[(base + hi).ravel()] - a
        some = np.flatnonzero(size)
        a, size = a[some], size[some]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(a - (ends - size), size)
        return np.bincount(self.at[at], self.weight[at] * np.repeat(w[some // len(lo)], size), self.n)

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None):
        """For each query (vectors, cosines) of the k nearest with a cosine above 0, nearest first; the smaller number
        first if equal. without: for each query a vector that is left out."""
        wide = np.zeros((len(queries), len(self.full)))
        for i, (t, w) in enumerate(queries):
            row = self.row[t]
            wide[i, row[row >= 0]] = w[row >= 0]
        known = wide @ self.full
        over = np.maximum.reduceat(known, np.arange(0, self.n, self.block), axis=1) if self.n else known
        for i, (t, w) in enumerate(queries):
            if not len(t) or not self.n:
                yield np.zeros(0, np.int64), np.zeros(0)
                continue
            rest = self.row[t] < 0
            t, w, sums = t[rest], w[rest], known[i]
            bound = over[i] + w @ self.most[t] + 1e-6
            order = np.argsort(-bound, kind="stable")
            m = max(FIRST, -(-2 * k // self.block))
            for blocks in (order[:m], order[m:]):
                kth = np.partition(sums, self.n - k)[self.n - k] if self.n > k else 0.0
                blocks = blocks[bound[blocks] >= kth]
                if len(blocks):
                    sums = sums + self._sums(t, w, blocks)
                if without:
                    sums[self.place[without[i]]] = -1
            sums = np.round(sums, 12)
            some = np.flatnonzero(sums >= max(1e-12, np.partition(sums, self.n - k)[self.n - k] if self.n > k else 0.0))
            ids = self.order[some]
            best = np.lexsort((ids, -sums[some]))[:k]
            yield ids[best], sums[some][best]


def monotone(x, y, w):
    """The steps of the weighted non-decreasing step function nearest to y over x, as (mean x, value): between them the
    fitted function is a line, beyond them level."""
    order = np.argsort(x, kind="stable")
    steps = []
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        steps.append([a * c, b * c, c, a])
        while len(steps) > 1 and (steps[-2][3] == a or steps[-2][1] / steps[-2][2] >= steps[-1][1] / steps[-1][2]):
            last = steps.pop()
            steps[-1] = [p + q for p, q in zip(steps[-1][:3], last[:3], strict=True)] + [a]
    return np.array([s[0] / s[2] for s in steps]), np.array([s[1] / s[2] for s in steps])


class Model:
    """Examples in order of doc_id, their index and the fitted votes. vectors: (term numbers in order, counts)."""

    def __init__(self, known, idf, docs, labels, weights, vectors, k: int):
        self.known, self.idf, self.k, self.docs = known, idf, k, docs
        self.labels = np.array(labels, float)
        unit = [self.unit(t, c) for t, c in vectors]
        self.index = Index(unit, len(known))
        w = np.array(weights, float)
        self.rest = float((w * self.labels).sum() / w.sum()) if len(w) else 0.0
        runs = [range(a, min(a + 256, len(unit))) for a in range(0, len(unit), 256)]
        votes = np.array([self.vote(*got) for run in runs for got in self.index.search([unit[i] for i in run], k, list(run))])
        some = np.flatnonzero(~np.isnan(votes)) if len(votes) else np.zeros(0, int)
        self.votes, self.value = monotone(votes[some], self.labels[some], w[some]) if len(some) else (np.zeros(1), np.full(1, self.rest))

    def unit(self, t, counts):
        """Term numbers in order and their weights, of length 1."""
        t = np.asarray(t, np.int64)
        w = (1 + np.log(np.asarray(counts, float))) * self.idf[t]
        return t, w / np.sqrt((w * w).sum()) if len(t) else w

    def vote(self, ids, near) -> float:
        weight = 1 / (1.05 - np.minimum(near, 1.0))
        return float((weight * self.labels[ids]).sum() / weight.sum()) if len(ids) else float("nan")

    def scores(self, texts):
        """(probability, examples nearest first, their cosines) of each of (term numbers, counts)."""
        for ids, near in self.index.search([self.unit(t, c) for t, c in texts], self.k):
            v = self.vote(ids, near)
            yield self.rest if v != v else float(np.interp(v, self.votes, self.value)), ids, near


def frequencies(texts: DataFrame, known: np.ndarray):
    """(rows, for each term the rows that hold it) of a table of one text column; at most SLICES rows reach the driver."""
    cuts = np.linspace(0, len(known) + 1, SLICES + 1).astype(int)
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def out(sums):
        for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([sums[a:b].tobytes()], pa.binary())], names=["slice", "n"])

    def counted(batches):
        sums = np.zeros(len(shared.value) + 1, np.int64)  # the last: rows
        for batch in batches:
            buf, offsets = utf8(batch.column(0))
            sums[-1] += batch.num_rows
            for _, _, b, o in chunks(buf, offsets):
                for t, _ in of_terms(b, o, shared.value):
                    sums[t] += 1
        yield from out(sums)

    def added(batches):
        sums = {}
        for batch in batches:
            for s, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[s] = sums.get(s, 0) + np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "n"])

    schema = "slice int, n binary"
    got = {r.slice: np.frombuffer(r.n, np.int64) for r in per_batch(per_batch(texts, counted, schema).repartition(SLICES, "slice"), added, schema).collect()}
    shared.destroy()
    whole = np.concatenate([got[s] for s in sorted(got)]) if got else np.zeros(len(known) + 1, np.int64)
    return int(whole[-1]), whole[:-1]


def fit(docs: DataFrame, labels: DataFrame, fold: int, held: int, examples: int, longest: int, k: int, doc: str, text: str, label: str) -> Model:
    taught = labels.where(fold_of(doc, fold) != held).select(doc, F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    drawn = F.broadcast(sample(taught, "label", examples, doc))
    short = docs.select(doc, F.coalesce(text, F.lit("")).alias("text")).where(F.length("text") <= longest)
    rows = short.join(drawn, doc).groupBy(doc, "label", "weight").agg(F.min("text").alias("text")).select("text", "label", "weight", doc)

    def run(batches):
        for batch in batches:
            buf, offsets = utf8(batch.column(0))
            out = []
            for _, _, b, o in chunks(buf, offsets):
                row, h = stems(b, o)
                for i in range(len(o) - 1):
                    u, n = np.unique(h[row == i], return_counts=True)
                    out.append((u.tobytes(), n.astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array([x[j] for x in out], pa.binary()) for j in (0, 1))], names=["label", "weight", doc, "h", "n"])

    kind = docs.schema[doc].dataType.simpleString()
    got = per_batch(rows, run, f"label int, weight double, `{doc}` {kind}, h binary, n binary").collect()  # at most 2 x examples rows of texts of up to `longest`
    got.sort(key=lambda r: (r[doc], r.label))
    found = [(np.frombuffer(r.h, np.uint64), np.frombuffer(r.n, np.int32)) for r in got]
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in found)]))
    if len({r.label for r in got}) < 2:
        return Model(known[:0], np.zeros(0), [], [], [], [], k)
    n, df = frequencies(docs.select(text), known)
    idf = np.log(1 + n / (df + SMOOTH * n)) ** POWER
    return Model(known, idf, [r[doc] for r in got], [r.label for r in got], [r.weight for r in got], [(np.searchsorted(known, h), c) for h, c in found], k)


def score(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1, examples: int = 1500, longest: int = 1 << 18, k: int = 100, threshold: float = 0.7, evidence: int = 5, doc: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc, held_out, score, predicted, neighbours): neighbours are the `evidence` nearest examples (id, label, cosine)."""
    rows = docs.select(doc, text)
    kind = rows.schema[doc].dataType
    if rows.isEmpty():
        return rows.select(doc, F.lit(False).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.expr(f"cast(array() as array<struct<{doc}: {kind.simpleString()}, label: int, cosine: double>>)").alias("neighbours")).limit(0)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fold, held, examples, longest, k, doc, text, label))

    def run(batches):
        m = model.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            buf, offsets = utf8(batch.column(1))
            out = [x for _, _, b, o in chunks(buf, offsets) for x in m.scores(of_terms(b, o, m.known))]
            near = [[{doc: m.docs[i], "label": int(m.labels[i]), "cosine": c} for i, c in zip(x[1][:evidence].tolist(), x[2][:evidence].tolist(), strict=True)] for x in out]
            scores = [x[0] for x in out]
            one = pa.struct([(doc, to_arrow_type(kind)), ("label", pa.int32()), ("cosine", pa.float64())])
            yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), pa.array(folds(ids, fold) == held), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(near, pa.list_(one))], names=[doc, "held_out", "score", "predicted", "neighbours"])

    name = kind.simpleString()
    return per_batch(rows, run, f"`{doc}` {name}, held_out boolean, score double, predicted int, neighbours array<struct<`{doc}`: {name}, label: int, cosine: double>>")
