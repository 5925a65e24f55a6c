"""Depth-limited expansion over a citation table: one join and one anti-join a layer, lineage cut in the shared folder."""

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.bindings import register


def checkpoint(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder that the cluster names; only a local master, as in tests, gets a new local one."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="scholion-"))
    return df.checkpoint()


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(node, depth): every node within `depth` steps of a seed over edges (src, dst) and the first layer that sees it.

    Seeds are found like others; a layer leaves out what earlier layers had. Null nodes are never reached."""
    layer = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct()
    seen = None
    if depth < 1:
        return layer.limit(0).withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        step = edges.join(layer, edges["src"] == layer["node"], "left_semi").select(F.col("dst").alias("node")).where("node is not null").distinct()
        if seen is not None:
            step = step.join(seen, "node", "left_anti")
        layer = checkpoint(step)
        found = layer.withColumn("depth", F.lit(d))
        seen = found if seen is None else seen.unionByName(found)
    return seen


def citation_bfs(spark, sf_dir):
    """Papers within two citations of the five best seeds."""
    register(spark, sf_dir, "cites scored")
    return expand(spark.table("cites"), spark.table("scored").where("score >= 70 and doi is not null").orderBy(F.desc("score"), "paper_id").limit(5).select("paper_id"))


ORACLE = """with one as (select distinct dst as node from cites where src in (select paper_id from scored where score >= 70 and doi is not null order by score desc, paper_id limit 5)), two as (select distinct dst as node from cites where src in (select node from one))
select node, cast(1 as int) as depth from one union all select node, cast(2 as int) as depth from two where node not in (select node from one)"""
