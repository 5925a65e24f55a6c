"""The façade: searches with a cache and a log, costs, and exports, over tables that lie in one folder.

Tables are appended to, so runs may share a folder; of rows of one key the last counts (results) or the first (papers).
Results are cached by query and limit. A search without hits is neither cached nor logged, and a cached one costs nothing.
"""

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators.loop import PaperSearch
from .plans.dialect import SPARK
from .plans.pairs import compiled
from .sources import files

INTENT = "keywords array<string>, synonyms map<string, array<string>>, must_include array<string>, exclude array<string>, author string, affiliation string, year_from int, year_to int, document_type string, subject_area array<string>, language string"
RESULTS = "query_hash string, query string, limit int, total_count bigint, created_at double, place int, paper_id string"
LOG = "session_id string, step int, action_type string, query_string string, result_count int, result_ids array<string>, cost_time double, created_at double"
#: Rows of a page of results.
PAGE = 20


def last_wins(rows: DataFrame, *key: str, at: str = "created_at") -> DataFrame:
    """The rows of each key that were written last."""
    newest = Window.partitionBy(*key)
    return rows.withColumn("_last", F.max(at).over(newest)).where(F.col(at) == F.col("_last")).drop("_last")


def replayed(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Requests (url, params) with the recorded response (key, response) to each; what was not found is an empty object.
    The key is the address and the parameters in order of name."""
    params = F.array_sort(F.map_entries(F.coalesce("params", F.create_map().cast("map<string, string>"))))
    key = F.concat(F.col("url"), F.lit("?{"), F.array_join(F.transform(params, lambda e: F.concat(F.lit('"'), e["key"], F.lit('": "'), e["value"], F.lit('"'))), ", "), F.lit("}"))
    return requests.withColumn("key", key).join(recorded.dropDuplicates(["key"]), "key", "left").withColumn("response", F.coalesce("response", F.lit("{}")))


class Engine:
    """Searches papers (paper_id, title, year, abstract, doi, citation_count, ...), with cache and log under `folder`."""

    def __init__(self, spark: SparkSession, papers: DataFrame, folder: str):
        self.spark, self.papers, self.folder, self.total_count = spark, papers.withColumn("paper_id", F.col("paper_id").cast("string")), folder.rstrip("/"), 0
        self.new_session()
        self.reset_cost()

    def new_session(self) -> str:
        """K7: a new session for the log, whose steps begin at 1."""
        self.session_id, self.step = uuid.uuid4().hex[:12], 0
        return self.session_id

    def reset_cost(self) -> None:
        self.cost = {"queries": 0, "pages_loaded": 0, "detail_pages_visited": 0, "fulltext_attempts": 0, "fulltext_successes": 0, "total_browser_time": 0.0, "api_calls_by_type": {}}

    def get_cost_summary(self) -> dict:
        return {**self.cost, "api_calls_by_type": dict(self.cost["api_calls_by_type"])}

    def _table(self, name: str, schema: str) -> DataFrame:
        """The table in the folder; empty before anything was written."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def search(self, query: str, limit: int = PAGE, year_range: tuple[int | None, int | None] | None = None, skip_cache: bool = False) -> DataFrame:
        """(place, paper columns) of the first `limit` hits, latest first; total_count then holds the number of all."""
        began = time.time()
        first, last = year_range or (None, None)
        whole = query + (f" AND PUBYEAR > {first - 1}" if first else "") + (f" AND PUBYEAR < {last + 1}" if last else "")
        key = self.spark.createDataFrame([(whole,)], "q string").select(F.expr(T.cache_key(SPARK, "q"))).first()[0]
        if not skip_cache:
            cached = last_wins(self._table("api_cache", RESULTS).where((F.col("query_hash") == key) & (F.col("limit") == limit)), "query_hash", "limit")
            if (one := cached.select("total_count").first()) is not None:
                self.total_count = one[0]
                return cached.select("place", "paper_id").join(self.papers, "paper_id")
        papers = self.papers.where((F.lit(not first) | (F.col("year") >= (first or 0))) & (F.lit(not last) | (F.col("year") <= (last or 0))))
        hits = PaperSearch(papers).run(self.spark.createDataFrame([(0, query)], "position int, query string"), 2**31 - 1)
        self.total_count = hits.count()
        if not self.total_count:
            return hits.select(F.col("rank").alias("place"), "paper_id").join(self.papers, "paper_id")
        found = hits.where(F.col("rank") <= limit).select(F.col("rank").alias("place"), "paper_id")
        now = time.time()
        found.select(F.lit(key).alias("query_hash"), F.lit(whole).alias("query"), F.lit(limit).alias("limit"), F.lit(self.total_count).cast("bigint").alias("total_count"), F.lit(now).alias("created_at"), "place", "paper_id").write.mode("append").parquet(f"{self.folder}/api_cache")
        ids = [r.paper_id for r in found.orderBy("place").collect()]  # `limit` rows
        self.record("search", now - began, whole, ids)
        return found.join(self.papers, "paper_id")

    def record(self, action: str, seconds: float, query: str = "", ids: list[str] = ()) -> None:
        """A2, K4: one action's cost, and its row in the log."""
        self.step += 1
        self.spark.createDataFrame([(self.session_id, self.step, action, query, len(ids), list(ids), float(seconds), time.time())], LOG).write.mode("append").parquet(f"{self.folder}/search_log")
        counter = {"search": "queries", "detail": "detail_pages_visited", "fulltext": "fulltext_attempts"}.get(action)
        if counter:
            self.cost[counter] += 1
        self.cost["total_browser_time"] += seconds
        self.cost["api_calls_by_type"][action] = self.cost["api_calls_by_type"].get(action, 0) + 1

    def session_log(self, session_id: str | None = None) -> DataFrame:
        """A session's actions in order of step."""
        return self._table("search_log", LOG).where(F.col("session_id") == (session_id or self.session_id)).orderBy("step")

    def compile(self, **intent) -> str:
        """An intent's query; language is english unless it says otherwise."""
        names = [c.strip().split()[0] for c in INTENT.replace("map<string, array<string>>", "map<>").split(",")]
        row = {n: intent.get(n) for n in names}
        row |= {n: list(row[n] or []) for n in ("keywords", "must_include", "exclude", "subject_area")} | {"synonyms": row["synonyms"] or {}, "language": "english" if row["language"] is None else row["language"]}
        return self.spark.createDataFrame([tuple(row[n] for n in names)], INTENT).select(F.expr(compiled())).first()[0]

    def search_by_intent(self, limit: int = PAGE, **intent) -> DataFrame:
        """K7: the hits of an intent: its keywords and phrases in its years."""
        words = " ".join([*intent.get("keywords", ()), *intent.get("must_include", ())])
        return self.search(words, limit, (intent.get("year_from"), intent.get("year_to")))

    def to_csv(self, papers: DataFrame, path: str, query: str = "") -> None:
        """K1, K7."""
        files.export_csv(papers, path, query, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))

    def to_csv_multi(self, results: list[DataFrame], path: str) -> None:
        """K2, K7: results one after the other, duplicates kept."""
        whole = results[0]
        for r in results[1:]:
            whole = whole.unionByName(r, allowMissingColumns=True)
        self.to_csv(whole, path)
