"""What a language model does in the original, as operators over a Judge: each builds requests, asks, and parses.

Prompts say what is asked in as few words as the answers' form needs; a deployment gives its own Judge and may word them as
it likes, since only op names and answer forms are fixed. Rows come back with the keys they were asked for.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import parsing
from .batches import batched, pre_filter
from .judge import Judge, each, parse_labels

MAX_ABSTRACT, EXTRACTED = 500, 1500


def _payloads(rows: DataFrame, head, line) -> DataFrame:
    """(batch, payload): the head and the lines of each batch of 15, in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("batch").agg(F.concat(head, F.lit("\n"), F.array_join(lines, "\n")).alias("payload"))


def _numbered_line(*parts):
    return F.concat(F.lit("["), F.col("seq"), F.lit("] "), *parts)


def relevance(judge: Judge, papers: DataFrame, question: str, threshold: int = 70, top: int | None = 20, routes: list[str] = (), order=()) -> DataFrame:
    """L1: papers (paper_id, title, year, abstract, ...) with labels, those of at least the threshold, the best `top`."""
    rows = batched(papers, *order)
    short = F.when(F.coalesce("abstract", F.lit("")) == "", "(no abstract)").when(F.length("abstract") > MAX_ABSTRACT, F.concat(F.substring("abstract", 1, MAX_ABSTRACT), F.lit("..."))).otherwise(F.col("abstract"))
    line = _numbered_line("title", F.lit(" | "), F.coalesce(F.col("year").cast("string"), F.lit("?")), F.lit(" | "), short)
    head = F.lit(f"{question}\nknown routes: {', '.join(sorted(routes)) or '(none yet)'}\nlabel each paper")
    got = parse_labels(each(judge, "relevance", _payloads(rows, head, line)), "batch")
    joined = rows.join(got.withColumnRenamed("idx", "seq"), ["batch", "seq"])
    best = joined.where(F.col("score") >= threshold)
    return best.orderBy(F.desc("score"), "seq").limit(top) if top is not None else best


def prefilter(judge: Judge, papers: DataFrame, question: str, order=()) -> DataFrame:
    """L2: papers without those that the titles show to be irrelevant; a batch without a readable answer stays."""
    rows = batched(papers, *order)
    asked = each(judge, "prefilter", _payloads(rows, F.lit(question), _numbered_line("title")))
    readable = asked.where(F.col("response").isNotNull())
    answers = parsing.parsed(readable, lambda r: [{"seq": i, "decision": str(d)} for i, d in parsing.decisions(r, 0, 0) if isinstance(i, int)], "seq bigint, decision string", "batch")
    known = parsing.parsed(readable, lambda r: [1] if parsing.array(r) is not None else [], "ok int", "batch").select("batch")
    here = answers.join(rows.select("batch", "seq"), ["batch", "seq"], "left_semi")  # numbers of other batches are ignored
    return pre_filter(rows, here, known)


def _ask(spark: SparkSession, judge: Judge, op: str, payload: str, parser, schema: str, tries: int = 1) -> DataFrame:
    """Rows that the parser makes of one answer; asked again, under another number, while it gives none."""
    got = None
    for n in range(tries):
        one = spark.range(1).select(F.lit(payload if not n else f"{payload}\ntry {n + 1}").alias("payload"), F.lit(0).alias("k"))
        got = parsing.parsed(each(judge, op, one), parser, schema, "k").drop("k")
        if tries == 1 or not got.isEmpty():
            break
    return got


def dimension(spark, judge: Judge, question: str, context: str, dim: str) -> DataFrame:
    """L4: (n, term) of one dimension, three tries."""
    return _ask(spark, judge, "dimension", f"{question}\n{context}\nterms of {dim}", lambda r: parsing.dimension(r, dim), "term string", 3)


def strategy_routes(spark, judge: Judge, question: str, context: str) -> DataFrame:
    """L3, U8: (n, term) of the mainstream routes and then of those that differ from them; routes that differ only in case,
    hyphens or blanks are one, the first."""
    first = _ask(spark, judge, "routes", f"{question}\n{context}\nmainstream routes", lambda r: parsing.dimension(r, "strategy_route"), "term string", 3)
    known = ", ".join(r.term for r in first.orderBy("n").collect())  # a list of a prompt's size
    more = _ask(spark, judge, "routes", f"{question}\n{context}\nroutes other than: {known or '(none)'}", lambda r: parsing.dimension(r, "strategy_route"), "term string", 3)
    both = first.withColumn("pass", F.lit(1)).unionByName(more.withColumn("pass", F.lit(2)))
    key = F.translate(F.lower(F.trim("term")), "- ", "")
    kept = both.withColumn("key", key).where("key <> ''").groupBy("key").agg(F.min(F.struct("pass", "n", "term")).alias("f")).select("f.*")
    return kept.select((F.row_number().over(Window.orderBy("pass", "n")) - 1).alias("n"), "term")


def families(spark, judge: Judge, routes: list[str], size: int = 30) -> DataFrame:
    """(batch, family, representative, members) in batches of 30 routes, three tries each."""
    out = spark.createDataFrame([], "batch int, n int, family string, representative string, members array<string>")
    for b in range(0, len(routes), size):
        payload = "families of\n" + "\n".join(f"- {r}" for r in routes[b : b + size])
        got = _ask(spark, judge, "families", payload, lambda r: [{"family": str(x.get("family") or ""), "representative": str(x["representative"]), "members": parsing.texts(x.get("members"))} for x in parsing.families(r)], "family string, representative string, members array<string>", 3)
        out = out.unionByName(got.withColumn("batch", F.lit(b // size)))
    return out


def term_matrix(spark, judge: Judge, question: str, context: str = "") -> tuple[DataFrame, DataFrame]:
    """(dim_ord, dim, n, term) and route families. A term stays in the first dimension that has it; without any
    strategy route the matrix fails."""
    parts = [(strategy_routes(spark, judge, question, context) if d == "strategy_route" else dimension(spark, judge, question, context, d)).select(F.lit(i).alias("dim_ord"), F.lit(d).alias("dim"), "n", "term") for i, d in enumerate(parsing.DIMENSIONS)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    first = whole.groupBy(F.lower(F.trim("term")).alias("key")).agg(F.min(F.struct("dim_ord", "n", "dim", "term")).alias("f")).select("f.dim_ord", "f.dim", "f.n", "f.term")
    routes = [r.term for r in whole.where("dim = 'strategy_route'").orderBy("n").collect()]  # a list of a prompt's size
    if not routes:
        raise ValueError("no strategy route: the term matrix failed")
    kept = {r.term for r in first.where("dim = 'strategy_route'").collect()}
    return first, families(spark, judge, [r for r in routes if r in kept])


def exploration(spark, judge: Judge, matrix: DataFrame, question: str, n: int = 5) -> DataFrame:
    """(n, query, strategy) that combine terms freely."""
    dims = matrix.groupBy("dim_ord", "dim").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]), ", ").alias("terms")).orderBy("dim_ord").collect()
    payload = f"{question}\n{n} queries of\n" + "\n".join(f"- {r.dim}: {r.terms}" for r in dims)
    return _ask(spark, judge, "exploration", payload, parsing.queries, "query string, strategy string")


def gap_queries(spark, judge: Judge, question: str, context: str, gaps: str, used: list[str], n: int = 4) -> DataFrame:
    """(n, query) for the gaps; the judge sees the last ten queries that were used."""
    return _ask(spark, judge, "gaps", "\n".join([question, context, gaps, *used[-10:], f"{n} queries"]), parsing.gap_queries, "query string")


def roles(judge: Judge, papers: DataFrame, question: str) -> DataFrame:
    """(paper_id, seq, role, why) of papers (place from 1, paper_id, title, year, citation_count), all in one request."""
    seq = papers.withColumn("seq", F.col("place") - 1).withColumn("batch", F.lit(0))
    line = _numbered_line(F.lit("("), F.coalesce(F.col("year").cast("string"), F.lit("None")), F.lit(", cited "), F.coalesce("citation_count", F.lit(0)), F.lit(") "), F.substring("title", 1, 120))
    got = parsing.parsed(each(judge, "roles", _payloads(seq, F.lit(question), line)), lambda r: [{"idx": x["idx"], "role": str(x["role"]), "why": str(x["why"])} for x in parsing.roles(r) if isinstance(x["idx"], int)], "idx int, role string, why string", "batch")
    return seq.join(got, seq["seq"] == got["idx"]).select("paper_id", F.col("n").alias("seq"), "role", "why")


KNOWLEDGE = (
    "problem string, strategy_routes array<string>, materials array<string>, characterization_methods array<string>, concepts array<string>, synonyms array<string>, broader_terms array<string>, historical_terms array<string>, "
    "physical_mechanisms array<struct<cause string, mechanism string, effect string>>, search_hypotheses array<struct<hypothesis string, rationale string, support_type string, evidence string, queries array<string>>>"
)


def extract(judge: Judge, papers: DataFrame, version: str = "1.1") -> DataFrame:
    """Knowledge records of papers (paper_id, title, year, abstract); a paper without a readable answer has none."""
    text = F.substring(F.when(F.coalesce("abstract", F.lit("")) == "", "(no abstract)").otherwise(F.col("abstract")), 1, EXTRACTED)
    rows = papers.select("paper_id", F.substring(F.coalesce(F.nullif("abstract", F.lit("")), "title", F.lit("")), 1, 500).alias("source_text"), F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("?")), text).alias("payload"))
    got = each(judge, "extract", rows)
    names = ["problem", *parsing.LISTS, "physical_mechanisms", "search_hypotheses"]
    known = parsing.parsed(got, lambda r: [k] if (k := parsing.knowledge(r)) else [], KNOWLEDGE, "paper_id").select("paper_id", *names)
    return known.join(got.select("paper_id", "source_text"), "paper_id").withColumn("extractor_version", F.lit(version)).withColumn("confidence", F.lit(1.0))


def normalize(spark, judge: Judge, raw: list[str]) -> DataFrame:
    """(raw, canonical); itself where the answer has none."""
    raw = list(dict.fromkeys(raw))
    if not raw:
        return spark.createDataFrame([], "raw string, canonical string")
    one = spark.range(1).select(F.lit(0).alias("k"), F.lit("canonical names of\n" + "\n".join(f"- {r}" for r in raw)).alias("payload"))
    return parsing.parsed(each(judge, "normalize", one), lambda r: [{"raw": str(a), "canonical": str(b)} for a, b in parsing.canonical(r, raw).items()], "raw string, canonical string", "k").select("raw", "canonical")


def classify(spark, judge: Judge, routes: list[str]) -> DataFrame:
    """(route, type, family, strategy) of each route."""
    routes = list(dict.fromkeys(routes))
    if not routes:
        return spark.createDataFrame([], "route string, type string, family string, strategy string")
    one = spark.range(1).select(F.lit(0).alias("k"), F.lit("kinds of\n" + "\n".join(f"- {r}" for r in routes)).alias("payload"))
    return parsing.parsed(each(judge, "classify", one), lambda r: [{k: str(v or "") for k, v in x.items()} for x in parsing.ontology(r, routes)], "route string, type string, family string, strategy string", "k").drop("k", "n")


def plain_queries(spark, judge: Judge, question: str, context: str = "", n: int = 4, language: str = "english") -> DataFrame:
    """(n, query): a question's queries at once."""
    return _ask(spark, judge, "queries", f"{question}\n{context}\n{n} queries, LANGUAGE({language})", parsing.query_lines, "query string")


