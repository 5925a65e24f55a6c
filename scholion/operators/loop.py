"""The iterative search: queries, labels, citations, coverage and gaps, round after round.

A round is one set of jobs for all of its queries. What the original learns from query to query inside a round is an order
here: a paper or route is new for the first query, by position, that has it. State between rounds is written to the shared
folder, so a round's plan does not grow with the rounds before it. Lists that reach the driver are a round's queries, the
routes' names in a prompt and the gap text.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.dialect import SPARK
from ..plans.pairs import PAIRS, return_score
from . import assist, mmr
from .bfs import checkpoint
from .judge import Judge

#: Rows a query may return, its share of the coverage merge, papers from which titles are screened first, free queries, gap queries.
RETURNED, QUOTA, SCREENED, EXPLORED, GAPS = 200, 25, 30, 5, 4
PAPER = ("paper_id", "title", "year", "abstract", "doi", "citation_count")
KEY = T.dedup_key(SPARK, "doi", "title", "year")


class PaperSearch:
    """Searches a table of papers: a hit has all words of a query in title or abstract; latest first."""

    def __init__(self, papers: DataFrame):
        self.papers = papers.select(*PAPER)

    def run(self, queries: DataFrame, limit: int = RETURNED) -> DataFrame:
        """(position, rank, paper columns) of queries (position, query)."""
        words = "array_distinct(filter(regexp_extract_all(lower({}), '[a-z0-9]+', 0), w -> length(w) > 2 and w not in ('and', 'title', 'abs', 'key', 'pre')))"
        asked = queries.select("position", F.expr(words.format("query")).alias("words")).select("position", F.size("words").alias("n"), F.explode("words").alias("word"))
        held = self.papers.select("paper_id", F.explode(F.expr(words.format("concat_ws(' ', title, abstract)"))).alias("word")).join(asked.select("word").distinct(), "word", "left_semi")
        hits = held.join(asked, "word").groupBy("position", "n", "paper_id").agg(F.count("*").alias("found")).where("found = n")
        best = Window.partitionBy("position").orderBy(F.desc("year"), "paper_id")
        return hits.select("position", "paper_id").join(self.papers, "paper_id").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


@dataclass
class Outcome:
    """What a run leaves: `best` is the re-ranked result, `qualified` all that qualify, `merged` those that the quota of each
    query keeps, `metrics` a row for each query, `funnel` the keys that reached each stage, `manifest` all queries."""

    best: DataFrame | None = None
    qualified: DataFrame | None = None
    merged: DataFrame | None = None
    metrics: DataFrame | None = None
    funnel: DataFrame | None = None
    manifest: list[tuple[int, str, str, str]] = field(default_factory=list)
    gaps: list[str] = field(default_factory=list)
    rounds: int = 0


def expand(cites: DataFrame, papers: DataFrame, scored: DataFrame, threshold: int, seeds: int = 5) -> DataFrame:
    """Papers that the best seeds refer to (15), that cite them (15) or are cited with them (10) and are not scored yet."""
    top = scored.where((F.col("score") >= threshold) & F.col("doi").isNotNull()).orderBy(F.desc("score"), "key").limit(seeds).select(F.col("paper_id").alias("seed"), "score")
    cited = cites.groupBy("dst").agg(F.count("*").alias("cited"))
    out = cites.join(top, cites["src"] == top["seed"]).select("seed", F.col("dst").alias("paper_id"), F.lit(1).alias("kind"), F.row_number().over(Window.partitionBy("seed").orderBy("dst")).alias("n")).where("n <= 15")
    to = cites.join(top, cites["dst"] == top["seed"]).select("seed", F.col("src").alias("paper_id")).join(cited.withColumnRenamed("dst", "paper_id"), "paper_id", "left")
    to = to.select("seed", "paper_id", F.lit(2).alias("kind"), F.row_number().over(Window.partitionBy("seed").orderBy(F.coalesce("cited", F.lit(0)).desc(), "paper_id")).alias("n")).where("n <= 15")
    pairs = cites.join(top, cites["dst"] == top["seed"]).select("seed", "src").join(cites, "src").where("dst <> seed").groupBy("seed", F.col("dst").alias("paper_id")).agg(F.count("*").alias("together"))
    near = pairs.select("seed", "paper_id", F.lit(3).alias("kind"), F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("together"), "paper_id")).alias("n")).where("n <= 10")
    every = out.unionByName(to).unionByName(near).join(top, "seed").join(papers.select(*PAPER), "paper_id").withColumn("key", F.expr(KEY))
    last = every.groupBy("key").agg(F.max_by(F.struct(*PAPER), F.struct(-F.col("score"), F.col("seed"), F.col("kind"), F.col("n"))).alias("p")).select("key", "p.*")
    return last.join(scored, "key", "left_anti")


def _append(before: DataFrame | None, more: DataFrame) -> DataFrame:
    return checkpoint(more if before is None else before.unionByName(more))


def run(judge: Judge, search, question: str, spark, context: str = "", target: int = 10, threshold: int = 70, max_rounds: int = 3, cites: DataFrame | None = None, papers: DataFrame | None = None) -> Outcome:
    """The whole search; without rounds the outcome is empty. cites and papers: the citation channel, left out without them."""
    done = Outcome()
    if max_rounds < 1:
        return done
    matrix, families = assist.term_matrix(spark, judge, question, context)
    first = _coverage_queries(matrix, families)
    asked = [(f"cov_{i}", q, "coverage") for i, q in enumerate(first)]
    asked += [(f"exp_{r.n}", r.query, "exploration") for r in assist.exploration(spark, judge, matrix, question, EXPLORED).orderBy("n").collect()]
    used, scored, per_query = [], None, None
    for number in range(1, max_rounds + 1):
        done.rounds = number
        done.manifest += [(number, *a) for a in asked]
        new = [(i, *a) for i, a in enumerate(asked) if a[1] not in used and a[1] not in [b[1] for b in asked[:i]]]
        start = len(used)
        used += [a[2] for a in new]
        if new:
            queries = spark.createDataFrame([(start + i, q, t, s) for i, (_, q, t, s) in enumerate(new)], "position int, qid string, query string, strategy string")
            scored, per_query, metrics, funnel = _round(judge, search, question, queries, scored, per_query, threshold)
            done.metrics = _append(done.metrics, metrics)
            done.funnel = _append(done.funnel, funnel)
        if cites is not None and scored is not None:
            labelled = assist.relevance(judge, expand(cites, papers, scored, threshold), question, 0, None, _routes(scored, threshold), (F.col("key"),))
            scored = _append(scored, labelled.select(*scored.columns))
        if scored is None:
            break
        done.qualified = scored.where(F.col("score") >= threshold)
        ranked = per_query.withColumn("n", F.row_number().over(Window.partitionBy("position").orderBy(F.desc("score"), "rank"))).where(F.col("n") <= QUOTA)
        kept = ranked.groupBy("key").agg(F.min_by(F.struct(*[c for c in scored.columns if c != "key"]), F.struct("position", "n")).alias("p")).select("key", "p.*")
        done.merged = checkpoint(kept.where(F.col("score") >= threshold))
        done.qualified.createOrReplaceTempView("scored")
        done.gaps = [r.gap for r in spark.sql(PAIRS["coverage_gaps"][0]).collect()]  # a row or two a route
        if done.merged.count() >= target and not done.gaps or number == max_rounds:
            break
        prompt = spark.sql(PAIRS["gap_text"][0]).first().prompt
        asked = [(f"gap_{len(used)}_{r.n}", r.query, "gap_filling") for r in assist.gap_queries(spark, judge, question, context, prompt, used, GAPS).orderBy("n").collect()]
        if not asked:
            break
    if done.merged is not None:
        rows = done.merged.select(F.lit(1).alias("run"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "key")).cast("bigint").alias("paper_id"), F.col("paper_id").alias("own"), "score", "route", "category", F.expr(T.stems(SPARK, "title")).alias("words"))
        rows = checkpoint(rows)  # papers that qualify, a result list's size
        done.best = mmr.rerank(rows, "run", target).join(rows.select("paper_id", "own", "score"), "paper_id").select("place", F.col("own").alias("paper_id"), "score")
    return done


def _routes(scored: DataFrame, threshold: int) -> list[str]:
    return [r.route for r in scored.where((F.col("score") >= threshold) & (F.coalesce("route", F.lit("")) != "")).select("route").distinct().collect()]


def _coverage_queries(matrix: DataFrame, families: DataFrame) -> list[str]:
    """Each family's representative, or else each route, with the first target property and the first failure problem."""
    first = {r.dim: r.term for r in matrix.groupBy("dim").agg(F.min_by("term", "n").alias("term")).collect()}
    routes = [r.representative for r in families.orderBy("batch", "n").collect()] or [r.term for r in matrix.where("dim = 'strategy_route'").orderBy("n").collect()]
    quoted = lambda x: (lambda y: f'"{y}"' if " " in y or "-" in y else y)(x.strip().strip('"').strip("'"))
    out = []
    for route in routes:
        if "target_properties" in first:
            out.append(f"TITLE-ABS-KEY({quoted(route)}) AND TITLE-ABS-KEY({quoted(first['target_properties'])})")
        if "failure_problem" in first and (q := f"TITLE-ABS-KEY({quoted(route)}) AND TITLE-ABS-KEY({quoted(first['failure_problem'])})") not in out:
            out.append(q)
    return out


def _round(judge, search, question, queries, scored, per_query, threshold):
    """(all scored papers, labels by query, metrics, keys by stage) after the queries of a round."""
    hits = checkpoint(search.run(queries.select("position", "query")).withColumn("key", F.expr(KEY)))
    unseen = hits if scored is None else hits.join(scored, "key", "left_anti")
    owner = unseen.groupBy("key").agg(F.min("position").alias("position"))
    fresh = checkpoint(unseen.join(owner, ["key", "position"], "left_semi"))
    many = fresh.groupBy("position").count().where(F.col("count") > SCREENED).select("position")
    order = (F.col("position"), F.col("rank"), F.col("paper_id"))
    screened = assist.prefilter(judge, fresh.join(many, "position", "left_semi"), question, order).select(*fresh.columns)
    left = checkpoint(screened.unionByName(fresh.join(many, "position", "left_anti")))
    labelled = checkpoint(assist.relevance(judge, left, question, 0, None, _routes(scored, threshold) if scored is not None else [], order))
    columns = ["key", *PAPER, "score", "reason", "category", "route", "info_gain", "evidence_type", "has_limitation"]
    mine = labelled.select("position", "rank", *columns)
    once = mine.groupBy("key").agg(F.min_by(F.struct(*columns[1:]), F.struct("position", "rank", "paper_id")).alias("p")).select("key", "p.*")
    known = (scored.select("route") if scored is not None else mine.select("route").limit(0)).where("route <> ''").distinct()
    routes = mine.where("route <> ''").groupBy("route").agg(F.min("position").alias("position")).join(known, "route", "left_anti").groupBy("position").agg(F.count("*").alias("new_routes"))
    metrics = queries.join(hits.groupBy("position").agg(F.count("*").alias("returned")), "position", "left").join(fresh.groupBy("position").agg(F.count("*").alias("new_candidates")), "position", "left")
    metrics = metrics.join(mine.groupBy("position").agg(F.count("*").alias("new_scored"), F.count(F.when(F.col("score") >= threshold, 1)).alias("new_relevant")), "position", "left").join(routes, "position", "left").fillna(0)
    metrics = metrics.withColumn("cost", F.lit(0.0)).withColumn("duplicate_rate", 1 - F.col("new_candidates") / F.greatest(F.col("returned"), F.lit(1))).withColumn("return_score", F.expr(return_score()))
    stages = [(hits, "raw"), (left, "prefilter"), (mine, "scored"), (mine.where(F.col("score") >= threshold), "qualified")]
    funnel = None
    for rows, name in stages:
        some = rows.select(F.expr(T.normalize_doi(SPARK, "doi")).alias("doi"), F.lit(name).alias("stage")).where("doi <> ''").distinct()
        funnel = some if funnel is None else funnel.unionByName(some)
    return _append(scored, once), _append(per_query, mine), metrics, funnel


def scripted(op: str, payload: str) -> str:
    """A whole model as fixed functions of the payload, for runs without one: terms, queries and labels by checksums."""
    import json
    import re
    import zlib

    if op == "dimension":
        return json.dumps({payload.rsplit(" ", 1)[-1]: {"target_properties": ["und"], "failure_problem": ["des"]}.get(payload.rsplit(" ", 1)[-1], [])})
    if op == "routes":
        return json.dumps({"strategy_route": ["der", "les"] if "mainstream" in payload else ["die", "que"]})
    if op == "families":
        return json.dumps([{"family": r, "representative": r, "members": [r]} for r in re.findall(r"^- (.*)$", payload, re.M)])
    if op == "exploration":
        return '[{"query": "the and"}, {"query": "los"}]'
    if op == "gaps":
        return '["une", "ist"]'
    lines = [(int(n), zlib.crc32(t.split(" | ")[0].encode())) for n, t in re.findall(r"^\[(\d+)\] (.*)$", payload, re.M)]
    if op == "prefilter":
        return json.dumps([{"index": n, "decision": "IRRELEVANT" if h % 5 == 0 else "UNCERTAIN"} for n, h in lines])
    return json.dumps([{"index": n, "score": 40 + h % 60, "route": f"route {h % 9}", "evidence_type": "review" if h % 4 == 0 else "simulation", "has_limitation": h % 3 == 0} for n, h in lines])


def iterative_search(spark, sf_dir):
    """The whole search over papers and citations with a scripted model; a row
    for each query that was asked, with what it added."""
    from ..plans.bindings import register
    from .judge import ScriptedJudge

    register(spark, sf_dir, "papers cites")
    papers = spark.table("papers")
    got = run(ScriptedJudge(scripted), PaperSearch(papers), "q", spark, cites=checkpoint(spark.table("cites")), papers=papers)
    return got.metrics.select("position", "qid", "query", "strategy", "returned", "new_candidates", "new_scored", "new_relevant", "new_routes", "duplicate_rate", "return_score")


QUERIES = {"iterative_search": iterative_search}
