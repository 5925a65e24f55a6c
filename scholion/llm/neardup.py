"""N-gram Jaccard self-join of whole texts: a size-aware heavy-light join, then connected components.

A text is the set of its distinct k-word shingles; texts of equal sets are one class, which takes part once. Two sets
link if 100 |A and B| >= t |A or B|. Then either misses at most d = n - ceil(t n / 100) of its own n shingles in the other,
so in any one order of all shingles their first d + c hold c common ones. The order puts shingles that repeat within a
block of a task and are frequent in sum last (the order steers cost only; any set of frequent shingles gives the same links).

Small sets (n up to the boundary) enumerate the pairs of their first d + 2 shingles; large ones, and small ones that a
large one could match, enter inverted lists with their first d + 1. The boundary is that of least estimated cost over
the sizes that occur. Lists are not multiplied out: members are first compared with a leader of their list, the one that meets most others, then
with a second; the links found contract to components, and only members of a list that are still apart are compared. A pair is
formed only where its place in both orders leaves enough shingles, and dropped early if parity sketches, a 32nd of the sets' size, bound its overlap too low; the rest are verified on the exact sets.

Components contract along smallest neighbours in rounds of joins. No link, component or fingerprint is collected; what
the driver gets are counts, a size histogram, and frequent shingles (at most `frequent_most`, the most frequent ones).

Defined cases: null and empty texts and texts of white space have no shingle and are linked with nothing; a null
doc_id has component null and links nothing; rows that repeat a doc_id are one document's, and their class or classes
carry its id; ties do not occur (sizes are exact); an empty table gives no rows; other columns are ignored. Sets are told
apart by 128-bit hashes, shingles by 64-bit ones.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .spans import chunks, hashes, mix, shingles, utf8, words
from .workspace import drop, per_batch, table

#: Bits of the parity sketch of a set: a power of two of at least this many and twice the set's size.
SKETCH = 1024
BROADCAST_IDS = 2_000_000
#: Shingles held by a task at a time to find those that repeat in it; counting them takes about 50 bytes each.
HELD = 1_000_000
#: Rounds in which the members of a list are compared with one of them, before those still apart are with each other.
LEADERS = 2


def needed(n, t: int):
    """The least overlap of a set of n with any that it links with."""
    return -(-t * n // 100)


def digests(found: np.ndarray) -> tuple[int, int]:
    """The two halves of the 128-bit hash of a set."""
    h = xxhash.xxh3_128_intdigest(found.tobytes())
    return (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63), (h >> 64) - (1 << 63)


def class_id(found: np.ndarray, clash=frozenset()) -> int:
    """The first half, or the second for a set whose first half another set has as well."""
    first, second = digests(found)
    return second if first in clash else first


def sketch(found: np.ndarray) -> bytes:
    """For every bit whether an odd number of the set's elements fall on it; halves of a longer sketch fold by exclusive or."""
    bits = max(SKETCH, 1 << (2 * len(found)).bit_length())
    return np.packbits((np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def most_common(na: int, nb: int, x: bytes, y: bytes) -> int:
    """The largest overlap of two sets of these sizes and sketches."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return min(na, nb, (na + nb - int(np.bitwise_count(x ^ y).sum())) // 2)


def sets(buf, offsets, k: int):
    data, at, first = words(buf, offsets)
    return shingles(hashes(data, at), first, k)


def described(docs: DataFrame, k: int, doc: str, text: str) -> DataFrame:
    """Rows of kind 0: (doc, n, cid, other, sketch) of each text; of kind 1: (cid: a shingle, n: its texts) of those that repeat in a block of a task."""
    kind = to_arrow_type(docs.schema[doc].dataType)
    names = ["kind", doc, "n", "cid", "other", "sketch"]

    def run(batches):
        held, size = [], 0

        def repeated():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            u, n = u[n > 1], n[n > 1]
            for lo in range(0, len(u), 100_000):
                m = len(u[lo : lo + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, kind), pa.array(n[lo : lo + 100_000], pa.int64()), pa.array(u[lo : lo + 100_000].view(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], names=names)

        for batch in batches:
            buf, offsets = utf8(batch.column(1))
            for lo, hi, b, o in chunks(buf, offsets):
                n, cid, marks = [], [], []
                for s in sets(b, o, k):
                    n.append(len(s))
                    cid.append(digests(s))
                    marks.append(sketch(s))
                    held.append(s)
                    size += len(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(hi - lo, np.int32)), batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), *(pa.array([c[i] for c in cid], pa.int64()) for i in (0, 1)), pa.array(marks, pa.binary())], names=names)
            if size > HELD:
                yield from repeated()
                held, size = [], 0
        if held:
            yield from repeated()

    return per_batch(docs.select(doc, text), run, f"kind int, `{doc}` {docs.schema[doc].dataType.simpleString()}, n bigint, cid bigint, other bigint, sketch binary")


def boundary(sizes: dict[int, int], t: int, weight: float) -> int:
    """The size up to which enumerating pairs costs least. weight: candidates that an entry of an inverted list costs."""
    order = sorted(sizes)
    pairs = [sizes[n] * (n - needed(n, t) + 2) * (n - needed(n, t) + 1) / 2 for n in order]
    lists = [sizes[n] * (n - needed(n, t) + 1) * (1 + weight) for n in order]
    best, cost, at = 0, sum(lists), 0
    for i in range(len(order)):
        above = order[i + 1] if i + 1 < len(order) else 1 << 60
        while at < len(order) and 100 * order[at] < t * above:  # sets that no larger one can match need no lists
            at += 1
        if (now := sum(pairs[: i + 1]) + sum(lists[at:])) < cost:
            best, cost = above - 1, now
        if pairs[i] > 50 * lists[i]:
            break
    return best


def signatures(docs: DataFrame, k: int, t: int, limit: int, frequent, clash, text: str) -> DataFrame:
    """(sig, cid, n, at): entries of lists and pairs of shingles, and the place of their first shingle in the order; each class once a task."""

    def run(batches):
        common, seen = frequent.value, set()
        for batch in batches:
            buf, offsets = utf8(batch.column(0))
            for _, _, b, o in chunks(buf, offsets):
                sig, cid, size, place = [np.zeros(0, np.uint64)], [], [], []
                for s in sets(b, o, k):
                    n, own = len(s), class_id(s, clash)
                    if 100 * n < t * (n + 1) or own in seen:  # too small for any other set to link with
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(own)
                    d = n - int(needed(n, t))
                    if len(common):
                        late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                        s = np.concatenate((s[~late][: d + 2], s[late][: d + 2])) if late.any() else s
                    out = []
                    if n > limit or 100 * n >= t * (limit + 1):
                        out.append((mix(s[: d + 1]), np.arange(min(d + 1, len(s)))))
                    if n <= limit:
                        i, j = np.triu_indices(min(d + 2, len(s)), 1)
                        a, c = np.minimum(s[i], s[j]), np.maximum(s[i], s[j])
                        out.append((mix(mix(a) * np.uint64(0x9E3779B97F4A7C15) + c), i))
                    for x, at in out:
                        sig.append(x)
                        place.append(at)
                        cid.append(np.full(len(x), own))
                        size.append(np.full(len(x), n))
                if cid:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(cid), pa.int64()), pa.array(np.concatenate(size), pa.int64()), pa.array(np.concatenate(place), pa.int32())], names=["sig", "cid", "n", "at"])

    return per_batch(docs.select(text), run, "sig bigint, cid bigint, n bigint, at int")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is one node of the component; nodes of edges (a, b) only."""
    edges = table(edges.select("a", "b").where("a != b").distinct(), "edges", few=True)
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a component's root has many pointers: tables on either side of a join let adaptive execution split such a key
        nearest = table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("label"), F.least("a", "m").alias("to")), "nearest", few=True)
        up = nearest
        for _ in range(2):  # follow the pointers
            far = up.select(F.col("label").alias("to"), F.col("to").alias("further"))
            up = up.join(far, "to", "left").select("label", F.coalesce("further", "to").alias("to"))
        up = table(up, "pointers", few=True)
        labels, was = table(labels.join(up, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels", few=True), labels
        ends = edges.join(up.withColumnsRenamed({"label": "a", "to": "x"}), "a").join(up.withColumnsRenamed({"label": "b", "to": "y"}), "b")
        edges, last = table(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a != b").distinct(), "edges", few=True), edges
        drop(nearest, up, was, last)
    return labels


def _apart(live: DataFrame, labels: DataFrame, by_sig) -> DataFrame:
    """live with labels: the lists whose members are in more than one component."""
    marked = live.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    return marked.withColumn("lo", F.min("label").over(by_sig)).withColumn("hi", F.max("label").over(by_sig)).where("lo != hi").drop("lo", "hi")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, t: int, clash, doc: str, text: str) -> DataFrame:
    """Those of the distinct pairs (a, b) of classes that link."""
    one = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"), F.col("keeper").alias(f"k{c}"))

    def bounded(batches):
        for batch in batches:
            keep = [(100 + t) * most_common(*x) >= t * (x[0] + x[1]) for x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1, 6, 7)], names=["a", "b", "ka", "kb"])

    kind = docs.schema[doc].dataType.simpleString()
    likely = pairs.join(one("a"), "a").join(one("b"), "b").where(f"100 * least(na, nb) >= {t} * greatest(na, nb) and ka is not null and kb is not null")
    likely = table(per_batch(likely.select("a", "b", "na", "nb", "sa", "sb", "ka", "kb"), bounded, f"a bigint, b bigint, ka {kind}, kb {kind}"), "likely")
    ids_table = table(likely.select(F.explode(F.array("ka", "kb")).alias(doc)).distinct(), "likely_ids", few=True)
    ids = F.broadcast(ids_table) if ids_table.count() <= BROADCAST_IDS else ids_table

    def whole(batches):
        for batch in batches:
            buf, offsets = utf8(batch.column(0))
            for _, _, b, o in chunks(buf, offsets):
                got = list(sets(b, o, k))
                yield pa.RecordBatch.from_arrays([pa.array([class_id(s, clash) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], names=["cid", "items"])

    full = per_batch(docs.select(doc, text).join(ids, doc, "left_semi").select(text), whole, "cid bigint, items binary")
    full = table(full.dropDuplicates(["cid"]), "sets")

    def exact(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append((100 + t) * both >= t * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    held = lambda c: full.select(F.col("cid").alias(c), F.col("items").alias(f"i{c}"))
    links = table(per_batch(likely.select("a", "b").join(held("a"), "a").join(held("b"), "b").select("a", "b", "ia", "ib"), exact, "a bigint, b bigint"), "links")
    drop(likely, ids_table, full)
    return links


def join(docs: DataFrame, k: int = 4, t: int = 85, frequent_from: int = 64, frequent_most: int = 1_000_000, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_shingles, component_id) for each row."""
    spark = docs.sparkSession
    rows = docs.select(doc, text)
    first = table(described(rows, k, doc, text), "described")
    each = first.where("kind = 0").select(doc, "n", "cid", "other", "sketch")
    common = first.where("kind = 1").groupBy("cid").agg(F.sum("n").alias("n")).where(F.col("n") >= frequent_from).orderBy(F.desc("n"), "cid").limit(frequent_most)
    common = np.sort(common.select("cid").toPandas()["cid"].to_numpy(np.int64).view(np.uint64))  # at most frequent_most; sets the order only
    frequent = spark.sparkContext.broadcast(common)
    sizes = {r.n: r["count"] for r in each.where("n > 0").groupBy("n").count().collect()}
    total = sum(n * c for n, c in sizes.items())
    again = first.where("kind = 1").agg(F.sum("n")).first()[0] or 0
    limit = boundary(sizes, t, 8 * again / total if total else 0)

    grouped = lambda rows: table(rows.where("n > 0").groupBy("cid").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.min(doc).alias("keeper"), F.min("other").alias("lo"), F.max("other").alias("hi")), "classes")
    classes = grouped(each)
    clash = frozenset(r.cid for r in classes.where("lo != hi").select("cid").toLocalIterator())  # some two of 10^10 distinct texts
    if clash:
        each = each.withColumn("cid", F.when(F.col("cid").isin(*clash), F.col("other")).otherwise(F.col("cid")))
        classes = grouped(each)
    by_sig = Window.partitionBy("sig")
    entries = signatures(rows, k, t, limit, frequent, clash, text).withColumn("lo", F.min("cid").over(by_sig)).withColumn("hi", F.max("cid").over(by_sig)).where("lo != hi")
    live = table(entries.select("sig", "cid", "n", "at").distinct(), "live")

    # leaders are the members that meet most others over all their lists: the original rather than a copy of it
    met = live.withColumn("m", F.count("*").over(by_sig)).withColumn("met", F.sum("m").over(Window.partitionBy("cid")))
    live, entered = table(met.withColumn("place", F.row_number().over(by_sig.orderBy(F.desc("met"), "cid"))).select("sig", "cid", "n", "at", "place"), "ranked"), live
    drop(entered)
    # of the list of the first shingle that two sets share, the places bound what they share; other lists need not hold the pair
    fit = f"100 * least(na, nb) >= {t} * greatest(na, nb) and (100 + {t}) * least(na - xa, nb - xb) >= {t} * (na + nb)"
    links = labels = None
    for leader in range(1, LEADERS + 1):
        apart = live.withColumn("label", F.col("cid")) if labels is None else _apart(live, labels, by_sig)
        lead = F.max(F.when(F.col("place") == leader, F.struct(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("at").alias("xa"), F.col("label").alias("la")))).over(by_sig)
        led = apart.withColumn("lead", lead).select("lead.*", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("at").alias("xb"), "label").where(f"la != label and a != b and {fit}")
        pairs = led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = verified(pairs, classes, rows, k, t, clash, doc, text)
        links = found if links is None else links.unionByName(found)
        labels = components(links)

    # what is left: members of a list that are in different components and were not compared with a leader
    apart = table(_apart(live, labels, by_sig).where(F.col("place") > LEADERS), "apart")
    other = apart.select("sig", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("at").alias("xb"), F.col("label").alias("lb"))
    rest = apart.select("sig", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("at").alias("xa"), F.col("label").alias("la")).join(other, "sig").where(f"a < b and la != lb and {fit}").select("a", "b").distinct()
    more = verified(rest, classes, rows, k, t, clash, doc, text)
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    grouped = labels.join(classes.select(F.col("cid").alias("node"), "keeper"), "node")
    least = table(grouped.groupBy("label").agg(F.min("keeper").alias("least")), "least", few=True)
    linked = grouped.join(least, "label").select(F.col("node").alias("cid"), "least")
    named = table(classes.join(linked, "cid", "left").select("cid", F.coalesce("least", "keeper").alias("component_id")), "named")
    out = each.select(doc, "n", "cid").join(named, "cid", "left")
    own = F.when(F.col(doc).isNull(), F.lit(None)).when(F.col("n") == 0, F.col(doc)).otherwise(F.col("component_id"))
    return out.select(doc, F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, t: int = 80, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: that of the smallest id, one row of it; rows without an id stay."""
    found = table(join(docs, k, t, doc=doc, text=text), "components")
    gone = found.where(F.col("component_id") != F.col(doc)).select(doc).distinct()
    twice = found.where(F.col(doc).isNotNull()).groupBy(doc).count().where("count > 1").select(doc)
    twice = table(twice, "repeated")
    small = lambda x: F.broadcast(x) if x.count() <= BROADCAST_IDS else x
    kept = docs.join(small(gone), doc, "left_anti")
    if twice.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(small(twice), doc, "left_semi").dropDuplicates([doc])
    return kept.join(small(twice), doc, "left_anti").select(docs.columns).unionByName(once.select(docs.columns))
