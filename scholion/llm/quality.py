"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade >= j) = logistic(w . x - t_j), with one weight vector for all grades and ordered thresholds t_1 <= t_2 <= ...
x is hashed text: each word and each word's shape count 1 / words, and statistics of the whole text (repetition, share of
capitals, of marks, length) fall into hashed buckets. The model is fitted on every rated row of the training folds:
features are written once, and each step of the optimiser sums the gradients of all of them, in tasks unless they are few.
A caller may bound the rows of a grade (`examples`, weighted back to the grades' shares) or the letters of a text
(`longest`); nothing is bounded otherwise. Ratings and ids are never inputs.

Defined cases: null and empty texts have the bucket of no words and are scored like others; rated rows with null doc_id or
grade teach nothing; of documents that repeat an id the least text teaches; with fewer than two grades everything is kept,
with tail probabilities of 1; a null doc_id is not held out; repeated rows are scored each; equal scores are no tie, as
each row is judged by itself; an empty table gives no rows; other columns are ignored, whatever their names.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .folds import fold as fold_of
from .folds import folds, sample
from .spans import chunks, hashes, mix, utf8, words
from .workspace import drop, per_batch, table

BITS = 18
#: Features (numbers with values) that are fitted on the driver; more are summed in tasks of TASK of them.
FEW = 1 << 20
TASK = 1 << 23
#: Ratings up to which they go to the texts; with more, both are shuffled.
RATINGS = 500_000
#: Sums of a gradient that travel as one row.
SLICE = 1 << 13

#: Class of a byte: small letter or beyond ASCII, capital, digit, other.
KIND = np.array([0 if b >= 128 or chr(b).islower() else 1 if chr(b).isupper() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)


def features(buf, offsets):
    """For each row (feature numbers, values)."""
    data, at, first = words(buf, offsets, lower=False)
    h = hashes(data, at)
    head, tail, size = data[at[:-1]], data[at[1:] - 1], np.diff(at)
    second, before = data[np.minimum(at[:-1] + 1, at[1:] - 1)], data[np.maximum(at[1:] - 2, at[:-1])]
    shape = mix(sum(scale * KIND[x].astype(np.uint64) for scale, x in zip(np.array([1, 4, 16, 64], np.uint64), (head, second, before, tail), strict=True)) + np.uint64(256) * np.minimum(size, 24).astype(np.uint64) + np.uint64(1 << 40))
    kind = KIND[data]
    same = np.concatenate(([0, 0], np.cumsum(h[1:] == h[:-1]))) if len(h) else np.zeros(1, np.int64)
    room = np.uint64((1 << BITS) - 1)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n:
            u, c = np.unique(np.concatenate((h[a:b], shape[a:b])), return_counts=True)
            distinct = len(np.unique(h[a:b])) / n
            letters = max(1, int(at[b] - at[a]))
            stats = [(1, n.bit_length(), int(distinct * 12)), (2, int((same[b] - same[a + 1]) / n * 10)), (3, int(np.count_nonzero(kind[at[a] : at[b]] == 1) / letters * 12)), (4, int(np.count_nonzero(kind[at[a] : at[b]] == 3) / letters * 24)), (5, n.bit_length()), (6, int(min(letters / n, 30)))]
        else:
            u, c, stats = np.zeros(0, np.uint64), np.zeros(0), [(5, 0)]
        s = mix(np.array([sum((x + 1) * 131**i for i, x in enumerate(t)) for t in stats], np.uint64) + np.uint64(1 << 50))
        yield (np.concatenate((u, s)) & room).astype(np.int64), np.concatenate((c / max(1, n), np.full(len(s), 0.5)))


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def sums(idx, val, size, grades, p, w, t) -> np.ndarray:
    """The negative log likelihood's slopes by each weight and by each threshold, and itself, over rows of weight p that have
    `size` features each."""
    edge, row, at = np.concatenate(([0], np.cumsum(size)[:-1])), np.repeat(np.arange(len(size)), size), np.arange(len(size))
    z = np.add.reduceat(w[idx] * val, edge)
    upper = np.concatenate((np.ones((len(z), 1)), logistic(z[:, None] - t), np.zeros((len(z), 1))), axis=1)  # P(grade >= j), j = 0 ... kinds
    lo, hi = upper[at, grades], upper[at, grades + 1]
    own = np.maximum(lo - hi, 1e-12)
    dlo, dhi = lo * (1 - lo), hi * (1 - hi)
    gw = np.bincount(idx, (p * (dhi - dlo) / own)[row] * val, len(w))
    gt = [(p * ((grades == j + 1) * dlo - (grades == j) * dhi) / own).sum() for j in range(len(t))]
    return np.concatenate((gw, gt, [-(p * np.log(own)).sum()]))


def minimise(total, tails: np.ndarray, steps: int, ridge: float, memory: int = 10):
    """(weights, thresholds) of least loss and ridge by L-BFGS with halved steps; total(w, t) is sums() over all rows, asked
    for at most `steps` times, and tails are the grades' shares P(grade >= j)."""
    tails = np.clip(tails, 1e-6, 1 - 1e-6)
    base = -np.log(tails / (1 - tails))
    at = np.concatenate((np.zeros(1 << BITS), base[:1], np.log(np.maximum(np.diff(base), 1e-3))))  # thresholds stay in order: the first, then logs of the steps
    w, gaps = slice(0, 1 << BITS), slice(1 << BITS, None)

    def thresholds(x):
        return np.cumsum(np.concatenate((x[gaps][:1], np.exp(np.minimum(x[gaps][1:], 40)))))

    def loss(x):
        found = total(x[w], thresholds(x))
        slope = found[:-1].copy()
        slope[w] += ridge * x[w]
        slope[gaps] = np.cumsum(found[gaps][:-1][::-1])[::-1] * np.concatenate(([1.0], np.exp(np.minimum(x[gaps][1:], 40))))
        return found[-1] + ridge / 2 * (x[w] @ x[w]), slope

    (now, slope), asked, past = loss(at), 1, []
    while asked < steps and np.abs(slope).max() > 1e-6:
        way, shares = -slope, []
        for s, y in reversed(past):
            shares.append((s @ way) / (s @ y))
            way -= shares[-1] * y
        if past:
            way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), share in zip(past, reversed(shares), strict=True):
            way += (share - (y @ way) / (s @ y)) * s
        far, fall = 1.0, slope @ way
        while asked < steps:
            then, steeper = loss(at + far * way)
            asked += 1
            if then <= now + 1e-4 * far * fall:
                break
            far /= 2
        else:
            break
        s, y = far * way, steeper - slope
        if s @ y > 1e-12 * (y @ y):
            past = [*past[1 - memory :], (s, y)]
        done = now - then <= 1e-9 * now
        at, now, slope = at + s, then, steeper
        if done:
            break
    return at[w], thresholds(at)


def train(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, weight: np.ndarray, kinds: int, steps: int = 40, ridge: float = 1e-4):
    """(weights, thresholds) of rows that are all here."""
    idx, val, size = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.array([len(r[0]) for r in rows])
    p = weight / weight.sum()
    return minimise(lambda w, t: sums(idx, val, size, grades, p, w, t), np.array([p[grades >= j].sum() for j in range(1, kinds)]), steps, ridge)


def summed(rated: DataFrame, kinds: list[int], weight: float, tasks: int):
    """total() of minimise() over a table of features: tasks sum their rows, then others sum the slices of those sums."""
    spark, parts = rated.sparkSession, rated.select("grade", "weight", "n", "i", "v").coalesce(tasks)

    def total(w, t):
        model = spark.sparkContext.broadcast((w, t))

        def run(batches):
            (w, t), out = model.value, None
            for batch in batches:
                if batch.num_rows:
                    grades, p, size = (batch.column(j).to_numpy() for j in range(3))
                    idx, val = utf8(batch.column(3))[0].view(np.int32), utf8(batch.column(4))[0].view(np.float32)
                    found = sums(idx, val.astype(float), size, np.searchsorted(kinds, grades), p / weight, w, t)
                    out = found if out is None else out + found
            if out is not None:
                for lo in range(0, len(out), SLICE):
                    if out[lo : lo + SLICE].any():
                        yield pa.RecordBatch.from_arrays([pa.array([lo // SLICE], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out[lo : lo + SLICE].tobytes()], pa.binary())], names=["lot", "task", "part"])

        def meet(batches):
            out = {}
            for batch in batches:
                for lot, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    out[lot] = out[lot] + np.frombuffer(part) if lot in out else np.frombuffer(part)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x.tobytes() for x in out.values()], pa.binary())], names=["lot", "part"])

        dealt = per_batch(parts, run, "lot int, task int, part binary").repartition("lot").sortWithinPartitions("lot", "task")
        out = np.zeros((1 << BITS) + len(kinds))
        for r in per_batch(dealt, meet, "lot int, part binary").collect():  # one number for each weight
            part = np.frombuffer(r.part)
            out[r.lot * SLICE : r.lot * SLICE + len(part)] = part
        model.destroy()
        return out

    return total


def fit(docs: DataFrame, ratings: DataFrame, fold: int, held: int, examples: int | None, longest: int | None, doc: str, text: str, grade: str):
    """(grades, weights, thresholds) learnt from the rated documents outside the held fold, None with fewer than two grades."""
    taught = ratings.where(fold_of(doc, fold) != held).select(doc, F.col(grade).cast("int").alias("grade"))
    if examples:
        drawn = F.broadcast(sample(taught, "grade", examples, doc).withColumnRenamed(doc, "doc"))
    else:
        drawn = taught.select(F.col(doc).alias("doc"), "grade").where("doc is not null and grade is not null").distinct().withColumn("weight", F.lit(1.0))
        drawn = F.broadcast(drawn) if taught.count() <= RATINGS else drawn
    texts = docs.select(F.col(doc).alias("doc"), F.coalesce(text, F.lit("")).alias("text"))
    short = texts.where(F.length("text") <= longest) if longest else texts
    rows = short.join(drawn, "doc").groupBy("doc", "grade", "weight").agg(F.min("text").alias("text")).select("text", "grade", "weight", "doc")

    def run(batches):
        for batch in batches:
            buf, offsets = utf8(batch.column(0))
            for lo, hi, b, o in chunks(buf, offsets):
                out = [(i.astype(np.int32), v.astype(np.float32)) for i, v in features(b, o)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[1:], pa.array([len(i) for i, _ in out], pa.int32()), pa.array([i.tobytes() for i, _ in out], pa.binary()), pa.array([v.tobytes() for _, v in out], pa.binary())], names=["grade", "weight", "doc", "n", "i", "v"])

    rated = table(per_batch(rows, run, f"grade int, weight double, doc {docs.schema[doc].dataType.simpleString()}, n int, i binary, v binary"), "rated")
    shares = sorted(rated.groupBy("grade").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).collect())  # a row a grade
    kinds, weight, n = [r.grade for r in shares], sum(r.weight for r in shares), sum(r.n for r in shares)
    if len(kinds) < 2:
        model = None
    elif n <= FEW:
        got = sorted(rated.collect(), key=lambda r: (r.doc, r.grade))  # at most FEW features
        model = kinds, *train([(np.frombuffer(r.i, np.int32), np.frombuffer(r.v, np.float32).astype(float)) for r in got], np.searchsorted(kinds, [r.grade for r in got]), np.array([r.weight for r in got]), len(kinds))
    else:
        tails = np.array([sum(r.weight for r in shares[j:]) / weight for j in range(1, len(kinds))])
        model = kinds, *minimise(summed(rated, kinds, weight, -(-n // TASK)), tails, 40, 1e-4)
    drop(rated)
    return model


def score(docs: DataFrame, ratings: DataFrame, fold: int = 5, held: int = 0, examples: int | None = None, longest: int | None = None, keep: int = 1, at_least: float = 0.5, doc: str = "doc_id", text: str = "text", grade: str = "grade") -> DataFrame:
    """(doc, held_out, expected_grade, tails array, kept): tails are P(grade >= j) for each grade but the lowest; a text is
    kept if the tail of the keep-th of them is at_least so much."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, ratings, fold, held, examples, longest, doc, text, grade))
    rows = docs.select(doc, text)
    kind = rows.schema[doc].dataType

    def run(batches):
        m = model.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            buf, offsets = utf8(batch.column(1))
            z = np.array([float(m[1][i] @ v) for _, _, b, o in chunks(buf, offsets) for i, v in features(b, o)]) if m else np.zeros(len(ids))
            tails = logistic(z[:, None] - m[2]) if m else np.ones((len(ids), 1))
            expected = m[0][0] + tails @ np.diff(m[0]) if m else np.zeros(len(ids))
            kept = tails[:, min(keep, tails.shape[1]) - 1] >= at_least
            yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), pa.array(folds(ids, fold) == held), pa.array(expected), pa.array(tails.tolist(), pa.list_(pa.float64())), pa.array(kept)], names=[doc, "held_out", "expected_grade", "tails", "kept"])

    return per_batch(rows, run, f"`{doc}` {kind.simpleString()}, held_out boolean, expected_grade double, tails array<double>, kept boolean")


def keep(docs: DataFrame, ratings: DataFrame, tail: int = 1, at_least: float = 0.5, fold: int = 5, held: int = 0, examples: int | None = None, longest: int | None = None, doc: str = "doc_id", text: str = "text", grade: str = "grade") -> DataFrame:
    """docs without the rows whose tail probability is under at_least; nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, ratings, fold, held, examples, longest, doc, text, grade))
    at = docs.columns.index(text)

    def run(batches):
        m = model.value
        for batch in batches:
            if m:
                buf, offsets = utf8(batch.column(at))
                z = np.array([float(m[1][i] @ v) for _, _, b, o in chunks(buf, offsets) for i, v in features(b, o)])
                batch = batch.filter(pa.array(logistic(z - m[2][min(tail, len(m[2])) - 1]) >= at_least))
            yield batch

    return per_batch(docs, run, docs.schema)


def graded(labels: DataFrame) -> DataFrame:
    """Ratings of three grades from the labels: 0 poor, 1 good but toxic, 2 good."""
    return labels.select("doc_id", F.expr("quality + if(quality > 0 and coalesce(toxic, 0) = 0, 1, 0)").alias("grade"))
