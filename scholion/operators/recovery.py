"""Recovery of early papers: citations backward for some layers, key words beside them, roles, and what was missed."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.bindings import register
from ..plans.dialect import SPARK
from ..plans.evaluation import D_DOI
from ..plans.pairs import PAIRS
from .bfs import checkpoint
from .numbering import numbered

#: A paper's key in a pool: its DOI, else its id.
KEY = f"coalesce(nullif({T.normalize_doi(SPARK, 'doi')}, ''), cast(paper_id as string))"


def references(cites: DataFrame, papers: DataFrame, of: DataFrame, limit: int) -> DataFrame:
    """(src, dst, n): of the first min(2 limit, 50) references of each paper of `of` those that are there, `limit` of them."""
    first = Window.partitionBy("src").orderBy("dst")
    own = cites.join(of.select(F.col("paper_id").alias("src")), "src", "left_semi").withColumn("m", F.row_number().over(first)).where(F.col("m") <= min(2 * limit, 50))
    return own.join(papers.select(F.col("paper_id").alias("dst")), "dst", "left_semi").withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit).select("src", "dst", "n")


def citation_pool(cites: DataFrame, papers: DataFrame, seeds: DataFrame, depth: int = 2, limit: int = 50) -> DataFrame:
    """(key, paper_id, depth): papers within `depth` references of the seeds and the first layer that has them. Only papers
    with a DOI are followed, each DOI once; of papers of one key the first reference of the smallest paper stands."""
    keyed = papers.select("paper_id", "doi", F.expr(KEY).alias("key"))
    followed = keyed.where(f"{T.normalize_doi(SPARK, 'doi')} <> ''")
    frontier = followed.join(seeds.select("paper_id"), "paper_id", "left_semi").groupBy("key").agg(F.min("paper_id").alias("paper_id"))
    seen, pool = frontier.select("key"), None
    for layer in range(1, depth + 1):
        met = references(cites, papers, frontier, limit).join(keyed.withColumnRenamed("paper_id", "dst"), "dst")
        step = met.groupBy("key").agg(F.min_by("dst", F.struct("src", "n")).alias("paper_id"))
        if pool is not None:
            step = step.join(pool, "key", "left_anti")
        step = checkpoint(step.withColumn("depth", F.lit(layer)))
        pool = step if pool is None else pool.unionByName(step)
        frontier = followed.join(step, ["key", "paper_id"], "left_semi").join(seen, "key", "left_anti").select("key", "paper_id")
        seen = seen.unionByName(frontier.select("key"))
    return pool


def candidates(cited: DataFrame, found: DataFrame, papers: DataFrame) -> DataFrame:
    """The citation pool, and papers (paper_id) that key words found and it lacks, at depth 0."""
    keyed = found.join(papers, "paper_id").select(F.expr(KEY).alias("key"), "paper_id").groupBy("key").agg(F.min("paper_id").alias("paper_id"))
    return cited.unionByName(keyed.join(cited, "key", "left_anti").withColumn("depth", F.lit(0)))


def recover(pool: DataFrame, papers: DataFrame, roles: DataFrame, early_year: int = 2015, top: int = 30) -> DataFrame:
    """(place, paper_id, depth, role, why): the most cited papers of the pool up to a year; a paper's last role counts, OTHER
    stands for none. roles: (paper_id, seq, role, why)."""
    early = pool.join(papers.select("paper_id", "year", "citation_count"), "paper_id").where((F.col("year") > 0) & (F.col("year") <= early_year))
    best = early.orderBy(F.coalesce("citation_count", F.lit(0)).desc(), "key").limit(top)
    place = F.row_number().over(Window.orderBy(F.coalesce("citation_count", F.lit(0)).desc(), "key")).alias("place")  # of `top` rows
    given = roles.groupBy("paper_id").agg(F.max_by(F.struct("role", "why"), "seq").alias("given"))
    return best.select(place, "paper_id", "depth").join(given, "paper_id", "left").select("place", "paper_id", "depth", F.coalesce("given.role", F.lit("OTHER")).alias("role"), F.coalesce("given.why", F.lit("")).alias("why"))


def _pool(spark, sf_dir):
    text = PAIRS["keyword_recall"][0]
    register(spark, sf_dir, text + " cites scored gold query_hits")
    papers = spark.table("papers")
    seeds = spark.table("scored").where("score >= 70 and doi is not null").orderBy(F.desc("score"), "paper_id").limit(5)
    found = spark.sql(text).select("paper_id").distinct()
    return papers, checkpoint(candidates(citation_pool(spark.table("cites"), papers, seeds), found, papers))


ROLES = "select paper_id, seq * 1000 + qid as seq, case seq % 3 when 0 then 'FOUNDATIONAL' when 1 then 'EARLY_MECHANISM' else 'REVIEW' end as role, concat('seq ', cast(seq as varchar(20))) as why from query_hits"


def citation_pool_layers(spark, sf_dir):
    """The pool of both channels for the five best seeds, with the layer of each paper."""
    return _pool(spark, sf_dir)[1].select("key", "paper_id", "depth")


def role_join(spark, sf_dir):
    """The thirty most cited early papers of the pool with their roles."""
    papers, pool = _pool(spark, sf_dir)
    return recover(pool, papers, spark.sql(ROLES))


def foundational_recall(spark, sf_dir):
    """A4: the share of the key papers up to 2015 (an unknown year counts as late) that are among the recovered ones, by DOI."""
    papers, pool = _pool(spark, sf_dir)
    early = recover(pool, papers, spark.sql(ROLES).limit(0)).join(papers, "paper_id").select(F.expr(T.normalize_doi(SPARK, "doi")).alias("doi")).where("doi <> ''").distinct()
    target = spark.table("gold").where("coalesce(year, 9999) <= 2015").select("item_id", F.expr(T.normalize_doi(SPARK, "doi")).alias("doi"))
    return target.join(early.withColumn("hit", F.lit(1)), "doi", "left").agg(F.count("item_id").alias("target_total"), F.count("hit").alias("found"), F.round(F.coalesce(F.try_divide(F.count("hit"), F.count("item_id")), F.lit(0.0)), 6).alias("recall"))


def pool_rank(spark, sf_dir):
    """For each key paper up to 2015 whether the pool has it, its rank there by citations, and the pool's recall."""
    papers, pool = _pool(spark, sf_dir)
    cited = pool.join(papers.select("paper_id", F.coalesce("citation_count", F.lit(0)).alias("cited")), "paper_id")
    ranked = numbered(cited, F.desc("cited"), F.col("key")).select(F.col("key").alias("doi"), "depth", "cited", F.col("place").cast("int").alias("place"))
    target = spark.table("gold").where("coalesce(year, 9999) <= 2015").select("item_id", F.expr(T.normalize_doi(SPARK, "doi")).alias("doi"))
    whole = Window.partitionBy(F.lit(1))
    out = target.join(ranked, "doi", "left").withColumn("in_pool", F.count("place").over(whole)).withColumn("targets", F.count("item_id").over(whole))  # of the key papers
    return out.crossJoin(pool.agg(F.count("*").alias("pool"))).select("item_id", "depth", "cited", "place", "pool", "in_pool", "targets", F.when(F.col("place").isNull(), "NOT IN POOL").otherwise("IN POOL").alias("verdict"))


D_POOL = f"""k as (select paper_id, doi, {D_DOI} as d, case when {D_DOI} <> '' then {D_DOI} else paper_id::varchar end as key, year, citation_count from papers),
refs as (select src, dst, row_number() over (partition by src order by dst) as n from (select src, dst from cites qualify row_number() over (partition by src order by dst) <= 50) where dst in (select paper_id from papers)),
f1 as (select key, min(paper_id) as paper_id from k where paper_id in (select paper_id from scored where score >= 70 and doi is not null order by score desc, paper_id limit 5) and d <> '' group by key),
l1 as (select key, arg_min(dst, src * 100 + n) as paper_id from refs join k on k.paper_id = dst where src in (select paper_id from f1) group by key),
f2 as (select l1.key, l1.paper_id from l1 join k using (paper_id) where d <> '' and l1.key not in (select key from f1)),
l2 as (select key, arg_min(dst, src * 100 + n) as paper_id from refs join k on k.paper_id = dst where src in (select paper_id from f2) and key not in (select key from l1) group by key),
kw as ({PAIRS["keyword_recall"][1]}), l0 as (select key, min(paper_id) as paper_id from k where paper_id in (select paper_id from kw) and key not in (select key from l1 union select key from l2) group by key),
pool as (select *, 1 as depth from l1 union all select *, 2 from l2 union all select *, 0 from l0),
early as (select p.*, cast(row_number() over (order by coalesce(citation_count, 0) desc, p.key) as int) as place from pool p join k using (paper_id) where year between 1 and 2015 qualify place <= 30)"""

ORACLES = {
    "citation_pool_layers": f"with {D_POOL} select * from pool",
    "role_join": f"with {D_POOL}, r as (select paper_id, arg_max(role, seq) as role, arg_max(why, seq) as why from ({ROLES}) group by paper_id) select place, early.paper_id, depth, coalesce(role, 'OTHER') as role, coalesce(why, '') as why from early left join r using (paper_id)",
    "foundational_recall": f"""with {D_POOL}, t as (select {D_DOI} in (select d from early join k using (paper_id)) as hit from gold where year <= 2015) select count(*) as target_total, count(*) filter (hit) as found, round(count(*) filter (hit) / cast(count(*) as double), 6) as recall from t""",
    "pool_rank": f"""with {D_POOL}, r as (select p.key, depth, coalesce(citation_count, 0) as cited, cast(row_number() over (order by coalesce(citation_count, 0) desc, p.key) as int) as place from pool p join k using (paper_id))
select item_id, depth, cited, place, (select count(*) from pool) as pool, count(place) over () as in_pool, count(*) over () as targets, case when place is null then 'NOT IN POOL' else 'IN POOL' end as verdict from gold left join r on r.key = {D_DOI} where year <= 2015""",
}
QUERIES = {f.__name__: f for f in (citation_pool_layers, role_join, foundational_recall, pool_rank)}
