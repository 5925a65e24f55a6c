"""Numbered rows: batches for a judge, the pre-filter over them, and the ranked merge of all queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.bindings import register
from .numbering import numbered

#: Papers in a request.
SIZE = 15


def batched(papers: DataFrame, *order, size: int = SIZE) -> DataFrame:
    """papers with seq (global, from 0), batch and idx (within the batch)."""
    n = F.col("_place") - 1
    return numbered(papers, *(order or (F.col("paper_id"),)), name="_place").withColumn("seq", n.cast("bigint")).withColumn("batch", F.floor(n / size).cast("bigint")).withColumn("idx", (n % size).cast("int")).drop("_place")


def pre_filter(batches: DataFrame, answers: DataFrame, answered: DataFrame) -> DataFrame:
    """Rows of batched() that a judge's answers (seq, decision) keep: only IRRELEVANT goes, and so does what the answer of a
    batch (answered: batch) leaves out; batches without an answer stay whole."""
    kept = batches.join(answered.select("batch").distinct().withColumn("_answered", F.lit(True)), "batch", "left").join(answers.select("seq", "decision"), "seq", "left")
    return kept.where("_answered is null or decision <> 'IRRELEVANT'").drop("_answered")


def batch_ids(spark, sf_dir):
    """F8: batches of 15 with the global index and that in the batch."""
    register(spark, sf_dir, "papers")
    return batched(spark.table("papers").select("paper_id")).select("paper_id", "seq", "batch", "idx")


def prefilter_recall_first(spark, sf_dir):
    """Batches of 15 and recorded decisions; every fourth batch has no answer, and answers leave some papers out."""
    register(spark, sf_dir, "papers decisions")
    rows = batched(spark.table("papers").select("paper_id"))
    answers = rows.where("batch % 4 <> 3 and idx <> 5").join(spark.table("decisions"), "paper_id")
    return pre_filter(rows, answers, rows.where("batch % 4 <> 3")).select("paper_id", "batch", "decision")


def global_merge(spark, sf_dir):
    """O3: the first row of each paper over all queries, then the threshold, best first."""
    register(spark, sf_dir, "query_hits")
    first = spark.table("query_hits").groupBy("paper_id").agg(F.min(F.struct("seq", "qid", "score")).alias("f")).select("paper_id", "f.qid", "f.score", "f.seq").where("score >= 70")
    return numbered(first, F.desc("score"), F.col("seq"), F.col("paper_id")).select("paper_id", "qid", "score", F.col("place").cast("int").alias("place"))


QUERIES = {f.__name__: f for f in (batch_ids, prefilter_recall_first, global_merge)}
ORACLES = {
    "batch_ids": "select paper_id, n as seq, n // 15 as batch, cast(n % 15 as int) as idx from (select paper_id, row_number() over (order by paper_id) - 1 as n from papers)",
    "prefilter_recall_first": """with b as (select paper_id, (row_number() over (order by paper_id) - 1) // 15 as batch, (row_number() over (order by paper_id) - 1) % 15 as idx from papers)
select paper_id, batch, case when batch % 4 <> 3 then decision end as decision from b join decisions using (paper_id) where batch % 4 = 3 or (idx <> 5 and decision <> 'IRRELEVANT')""",
    "global_merge": """select paper_id, qid, score, cast(row_number() over (order by score desc, seq, paper_id) as int) as place
from (select * from query_hits qualify row_number() over (partition by paper_id order by seq, qid, score) = 1) where score >= 70""",
}
