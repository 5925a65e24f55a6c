"""Language identification by rank-order profiles of character n-grams.

A text's letters are lower-cased, every other run of characters is one blank, and n-grams of 1 to 4 characters are taken
within words with a blank at either end. A language's profile is its most frequent n-grams over all its training texts,
in order; a text is compared with each profile by the out-of-place distance of its own most frequent n-grams (a missing
n-gram counts as the profile's length). Training counts are summed in the tasks and shuffled as (language, n-gram, n), so
a language that holds most rows is no more work for one task; profiles are languages x size rows.

Defined cases: null text, or one without a letter, is `und` with score 0, also all texts if nothing was learnt; equal
distances go to the smaller language name; equally frequent n-grams rank by hash; a null doc_id is in no held-out fold,
null languages teach nothing; repeated rows count each; an empty table gives no rows; other columns are ignored.
"""

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .folds import folds, sample
from .spans import SPACE, chunks, code_points, mix, utf8
from .workspace import per_batch

LONGEST = 4
UNKNOWN = "und"
BUCKETS = 64
#: Bytes of a text whose n-grams are held at a time.
PIECE = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    """The lower case of every letter, 0 for every other code point."""
    out = np.zeros(0x110000, np.uint64)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            small = chr(c).lower()
            out[c] = ord(small) if len(small) == 1 else c
    return out


def ngrams(buf, offsets):
    """For each row the hashes of all its n-grams, as they occur."""
    at, point = code_points(buf)
    n = len(offsets) - 1
    first = np.searchsorted(at, offsets)
    sizes = np.diff(first)
    text = np.zeros(len(at) + 2 * n, np.uint64)
    text[np.arange(len(at)) + np.repeat(2 * np.arange(n) + 1, sizes)] = _letters()[point]
    heads = first[:-1] + 2 * np.arange(n)
    keep = text != 0
    keep[1:] |= text[:-1] != 0
    keep[heads] = True
    starts = np.concatenate(([0], np.cumsum(keep)))[np.append(heads, len(text))]
    text = text[keep]
    codes, valid = [mix(text + np.uint64(1))], [text != 0]
    for k in range(2, LONGEST + 1):
        codes.append(mix(codes[-1][:-1] * np.uint64(31) + text[k - 1 :]))
        inner = (text[:-1] != 0) | (text[1:] != 0) if k == 2 else valid[-1][:-1] & (text[k - 2 : -1] != 0) if k > 3 else text[1:-1] != 0
        valid.append(inner)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        yield np.concatenate([c[a : max(a, b - k)][v[a : max(a, b - k)]] for k, (c, v) in enumerate(zip(codes, valid, strict=True))])


def counted(buf, offsets):
    """For each row its distinct n-grams' hashes and their counts. A long text is read in pieces that end at white space,
    which no n-gram crosses; a longer run without any stays whole."""
    if len(offsets) > 2 or len(buf) <= PIECE:
        for grams in ngrams(buf, offsets):
            yield np.unique(grams, return_counts=True)
        return
    cuts, gaps = [0], np.flatnonzero(SPACE[buf])
    while len(buf) - cuts[-1] > PIECE:
        near = gaps[np.searchsorted(gaps, cuts[-1] + PIECE) :]
        if not len(near):
            break
        cuts.append(int(near[0]) + 1)
    sums = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for a, b in zip(cuts, [*cuts[1:], len(buf)], strict=True):
        for grams in ngrams(buf[a:b], np.array([0, b - a])):
            u, at = np.unique(np.concatenate((sums[0], grams)), return_inverse=True)
            sums = u, np.bincount(at, np.concatenate((sums[1], np.ones(len(grams)))), len(u)).astype(np.int64)
    yield sums


def ranked(found, n, size: int) -> np.ndarray:
    """The most frequent n-grams in order."""
    return found[np.argsort(-n, kind="stable")[:size]]


def summed(parts):
    """Distinct n-grams and their counts over (n-grams, counts) pairs."""
    g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return g, np.bincount(at, np.concatenate([p[1] for p in parts]), len(g)).astype(np.int64)


def profiles(df: DataFrame, hold, size: int, doc: str, text: str, lang: str) -> dict[str, np.ndarray]:
    """The ranked n-grams of each language of the rows that hold() leaves for training."""

    def run(batches):
        sums, room = {}, 0

        def out():
            for name, parts in sums.items():
                g, n = summed(parts)
                for lo in range(0, len(g), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g[lo : lo + 50_000])), pa.array(g[lo : lo + 50_000].view(np.int64)), pa.array(n[lo : lo + 50_000])], names=["lang", "gram", "n"])

        for batch in batches:
            ids, names = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            teach = ~hold(ids) & np.array([x is not None for x in names], bool)
            buf, offsets = utf8(batch.column(1))
            for lo, hi, b, o in chunks(buf, offsets):
                by = {}
                for i, found in zip(range(lo, hi), counted(b, o), strict=True):
                    if teach[i]:
                        by.setdefault(names[i], []).append(found)
                for name, parts in by.items():
                    sums.setdefault(name, []).append(summed(parts))
                    room += len(sums[name][-1][0])
            if room > 2_000_000:
                yield from out()
                sums, room = {}, 0
        yield from out()

    counts = per_batch(df.select(doc, text, lang), run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the first of each of many shares of a language's n-grams, then the first of those: at most BUCKETS x size rows meet
    share = Window.partitionBy("lang", F.pmod("gram", F.lit(BUCKETS))).orderBy(F.desc("n"), "gram")
    first = counts.withColumn("place", F.row_number().over(share)).where(F.col("place") <= size)
    top = first.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= size)
    out = {}
    for row in sorted(top.select("lang", "gram", "place").collect(), key=lambda r: (r.lang, r.place)):  # size rows a language
        out.setdefault(row.lang, []).append(row.gram)
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in out.items()}


def predict(df: DataFrame, fold: int = 4, held: int = 2, size: int = 300, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc, held_out, lang_pred, score, distance): score is the margin by which the nearest profile beats the second,
    0 to 1; distance is the mean out-of-place distance to the nearest, as a share of the largest possible."""

    def hold(ids):
        return folds(ids, fold) == held

    names, known, places = _table(profiles(df, hold, size, doc, text, lang), size)
    rows = df.select(doc, text)
    kind = to_arrow_type(rows.schema[doc].dataType)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            buf, offsets = utf8(batch.column(1))
            out = []
            for _, _, b, o in chunks(buf, offsets):
                out += [judged(*found, names, known, places, size) for found in counted(b, o)]
            pred, score, distance, _ = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(hold(ids)), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(distance, pa.float64())], names=[doc, "held_out", "lang_pred", "score", "distance"])

    return per_batch(rows, run, f"`{doc}` {rows.schema[doc].dataType.simpleString()}, held_out boolean, lang_pred string, score double, distance double")


def limits(df: DataFrame, learnt, hold, examples: int | None, spread: float, least: float, most: float, size: int, doc: str, text: str, lang: str) -> dict[str, float]:
    """The distance up to which a text counts as one of a language: `spread` standard deviations above the mean of all its
    training rows, or of at most `examples` of them if that is given, from `least` to `most`."""
    names, known, places = learnt
    rows = df.select(F.col(doc).alias("doc"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    if examples:
        rows = rows.drop("lang").join(F.broadcast(sample(df.select(doc, lang), lang, examples, doc).select(F.col(doc).alias("doc"), F.col(lang).alias("lang"))), "doc")

    def run(batches):
        sums = {}
        for batch in batches:
            teach = ~hold(batch.column(0).to_pylist()) & np.array([x in names for x in batch.column(2).to_pylist()], bool)
            batch = batch.filter(pa.array(teach))
            own = batch.column(2).to_pylist()
            buf, offsets = utf8(batch.column(1))
            for i, found in enumerate(f for _, _, b, o in chunks(buf, offsets) for f in counted(b, o)):
                if len(found[0]):
                    far = judged(*found, names, known, places, size)[3][names.index(own[i])]
                    n, one, two = sums.get(own[i], (0, 0.0, 0.0))
                    sums[own[i]] = n + 1, one + far, two + far * far
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([x[i] for x in sums.values()], pa.float64()) for i in range(3))], names=["lang", "n", "one", "two"])

    got = per_batch(rows, run, "lang string, n double, one double, two double").groupBy("lang").agg(*(F.sum(c).alias(c) for c in ("n", "one", "two"))).collect()  # a row a language
    return {r.lang: min(most, max(least, r.one / r.n + spread * max(0.0, r.two / r.n - (r.one / r.n) ** 2) ** 0.5)) for r in got}


def keep(df: DataFrame, least: float = 0.78, most: float = 0.95, spread: float = 5.0, examples: int | None = None, fold: int = 4, held: int = 2, size: int = 300, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """df without the rows that have no language: `und`, or farther from the nearest profile than its language's own texts
    are (see limits()); nothing is shuffled."""

    def hold(ids):
        return folds(ids, fold) == held

    names, known, places = _table(profiles(df, hold, size, doc, text, lang), size)
    far = limits(df, (names, known, places), hold, examples, spread, least, most, size, doc, text, lang) if names else {}
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            buf, offsets = utf8(batch.column(at))
            got = [judged(*found, names, known, places, size) for _, _, b, o in chunks(buf, offsets) for found in counted(b, o)]
            yield batch.filter(pa.array([x[0] != UNKNOWN and x[2] <= far.get(x[0], most) for x in got], pa.bool_()))

    return per_batch(df, run, df.schema)


def _table(learnt: dict, size: int):
    """Language names, all profile n-grams in order of hash, and the place of each in every profile (size: missing)."""
    names = sorted(learnt)
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(learnt[x] for x in names)]))
    places = np.full((len(known), len(names)), size, np.int64)
    for j, x in enumerate(names):
        places[np.searchsorted(known, learnt[x]), j] = np.arange(len(learnt[x]))
    return names, known, places


def judged(grams, n, names, known, places, size: int):
    """(language, score, distance, distances from all) of one text's n-grams and their counts."""
    if not len(grams) or not names:
        return UNKNOWN, 0.0, 1.0, ()
    own = ranked(grams, n, size)
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    there = np.where((known[at] == own)[:, None], places[at], size)
    far = np.where(there < size, np.abs(there - np.arange(len(own))[:, None]), size).sum(0) / (size * len(own))
    order = np.argsort(far, kind="stable")
    second = far[order[1]] if len(names) > 1 else 1.0
    return names[order[0]], float(1 - far[order[0]] / second) if second > 0 else 0.0, float(far[order[0]]), far
