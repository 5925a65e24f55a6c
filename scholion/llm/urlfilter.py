"""URL filters by a sort-merge range join, in DataFrame operations only.

A host's labels in reverse order make its canonical key, so "this host and its subdomains" is an interval of keys; a path
prefix is an interval of paths. Intervals of prefixes are nested or apart. Points and interval starts are sorted together by
key; a window sweeps each sorted run and carries the stack that stands at the interval opened last: its own prefix and all
that enclose it. Every interval that is active at a point is in that stack, and those of it that are prefixes of the point
are the active ones. Two sweeps follow each other: hosts among the rules' hosts, then paths among the paths of each rule
host. The stacks are made beforehand by looking every rule's own prefixes up among the rules, so a stack is as deep as
rules are nested, and a host with a million paths makes no long array.

Hosts and (host, path) pairs are swept once however many rows have them. A run is a group (two last labels; a rule host) and
a salt: groups with more than their share of points are dealt over several runs, each with the group's intervals; there are
at most as many such groups as shares, which bounds the table that is broadcast. Rule hosts of a single label go to the
groups of all hosts under them.

Defined cases: a url that is null or has no `://` has an empty host and path and the default verdict; so has one that no
rule fits. Rules with equal host and path: block wins. Longest: the longer host and path together, then the longer host.
Rules with a null or empty host fit nothing. Repeated rows and null page ids are kept; an empty table gives no rows;
other columns are ignored.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "\u0001"


def rules(spark: SparkSession, entries: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) entries as a table."""
    if not entries:
        return spark.sql("select '' verdict, '' host, '' path where false")
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in entries))))


def _labels(host):
    return F.reverse(F.split(host, r"\."))


def _key(labels):
    return F.concat(F.array_join(labels, MARK), F.lit(MARK))


def split_url(url):
    """Columns host and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def sweep(points: DataFrame, opened: DataFrame, group: str) -> DataFrame:
    """(group, key, active) of each distinct point (group, key): the entries of the stack whose key is a prefix of its own.
    opened: (group, key, stack array<struct<key, ...>>) of every interval; it is needed where its group has points."""
    shares = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = points.groupBy(group).agg(F.count("*").alias("n"))
    share = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // shares)
    sizes = counts.select(group, F.ceil(F.col("n") / share).cast("int").alias("runs"))
    hot = F.broadcast(sizes.where("runs > 1"))  # fewer than `shares` groups can hold more than a share
    run = F.expr("cast(pmod(xxhash64(key), coalesce(runs, 1)) as int)")
    here = points.join(hot, group, "left").select(group, run.alias("run"), "key", F.lit(1).alias("kind"))
    there = opened.join(sizes, group).select(group, F.explode(F.expr("sequence(0, runs - 1)")).alias("run"), "key", F.lit(0).alias("kind"), "stack")
    order = Window.partitionBy(group, "run").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = here.unionByName(there, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(order))
    return swept.where("kind = 1").select(group, "key", F.expr("filter(stack, x -> startswith(key, x.key))").alias("active"))


def judge(pages: DataFrame, filters: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row (page_id, url)."""
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    pairs = urls.select("host", "path").distinct()
    named = filters.where("host is not null and host != ''").select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    named = named.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))

    # rule hosts: the stack of each is the rule hosts among its own suffixes
    hosts = named.select("host").distinct().withColumn("labels", _labels(F.col("host")))
    suffixes = hosts.select("host", "labels", F.explode(F.expr("transform(sequence(1, size(labels)), i -> slice(labels, 1, i))")).alias("part"))
    nested = suffixes.select("host", "labels", _key(F.col("part")).alias("key")).join(hosts.select(_key(F.col("labels")).alias("key"), F.col("host").alias("outer")), "key")
    stacks = nested.groupBy("host", "labels").agg(F.collect_list(F.struct("key", "outer")).alias("stack"))
    two = F.array_join(F.slice("labels", 1, 2), MARK)
    met = pairs.select("host").distinct().withColumn("labels", _labels(F.col("host"))).select("host", two.alias("grp"), _key(F.col("labels")).alias("key"), F.element_at("labels", 1).alias("top"))
    deep = stacks.where("size(labels) > 1").select(two.alias("grp"), _key(F.col("labels")).alias("key"), "stack")
    flat = stacks.where("size(labels) = 1").select(F.element_at("labels", 1).alias("top"), _key(F.col("labels")).alias("key"), "stack")
    opened = deep.unionByName(met.select("grp", "top").distinct().join(flat, "top").select("grp", "key", "stack"))
    under = sweep(met.select("grp", "key"), opened, "grp").where("size(active) > 0").join(met.select("grp", "key", "host"), ["grp", "key"])
    under = pairs.join(under.select("host", F.expr("transform(active, x -> x.outer)").alias("outers")), "host").select("host", "path", F.explode("outers").alias("outer"))

    # rule paths: the stack of each is the paths of its host among its own prefixes, cut at the lengths that occur
    lengths = named.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    prefixes = named.join(lengths, "host").select("host", "path", F.explode(F.expr("filter(lengths, n -> n <= length(path))")).alias("n"))
    prefixes = prefixes.select("host", "path", F.expr("substring(path, 1, n)").alias("key")).join(named.select("host", F.col("path").alias("key"), "verdict"), ["host", "key"])
    ruled = prefixes.groupBy("host", "path").agg(F.collect_list(F.struct("key", "verdict")).alias("stack"))
    paths = sweep(under.select("outer", F.col("path").alias("key")).distinct(), ruled.select(F.col("host").alias("outer"), F.col("path").alias("key"), "stack"), "outer")
    longest = F.expr("array_max(transform(active, x -> struct(length(x.key) as size, x.key as key, x.verdict as verdict)))")
    fits = paths.where("size(active) > 0").select("outer", F.col("key").alias("path"), longest.alias("best"))

    best = F.max(F.struct((F.length("outer") + F.col("best.size")).alias("size"), F.length("outer").alias("host_size"), F.col("best.verdict").alias("verdict"), F.concat("outer", "best.key").alias("rule")))
    won = under.join(fits, ["outer", "path"]).groupBy("host", "path").agg(best.alias("won"))
    return urls.join(won, ["host", "path"], "left").select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
