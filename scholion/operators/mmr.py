"""Greedy re-ranking by maximal marginal relevance, one group at a time."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.bindings import register
from ..plans.dialect import DUCK, SPARK


def picks(scores, routes, categories, words, k: int, weight: float) -> list[int]:
    """Positions in order of picking; the earliest input wins ties. Each pick updates a running similarity, so it costs n."""
    n = len(scores)
    near, out, left = np.zeros(n), [], np.ones(n, bool)
    relevance = np.asarray(scores, float) / 100
    for _ in range(min(k, n)):
        value = np.where(left, weight * relevance - (1 - weight) * near, -np.inf)
        best = int(np.argmax(np.round(value, 12)))
        out.append(best)
        left[best] = False
        for i in np.flatnonzero(left):
            shared, either = len(words[i] & words[best]), len(words[i] | words[best])
            jaccard = shared / either if words[i] and words[best] else 0.0
            same = 1.0 if routes[i] and routes[i] == routes[best] else 0.6 if categories[i] and categories[i] == categories[best] else 0.0
            near[i] = max(near[i], same, jaccard)
    return out


def rerank(df: DataFrame, group: str, k: int = 10, weight: float = 0.7) -> DataFrame:
    """(group, paper_id, place): the k picks from all papers of each group; ids are unique per group.

    Left out before the papers meet are only those that cannot be picked: before the last pick one of the k best scores is
    left, whose value is at least weight * score / 100 - (1 - weight), and similarity only lowers a value."""
    from pyspark.sql import Window

    best = Window.partitionBy(group).orderBy(F.desc("score"), "paper_id")
    rows = df.select(group, "paper_id", F.coalesce("score", F.lit(0)).alias("score"), "route", "category", "words")
    top = rows.select(group, "paper_id", "score").withColumn("seq", F.row_number().over(best)).where(F.col("seq") <= k)
    least = top.groupBy(group).agg((weight * F.min("score") - 100 * (1 - weight) - 1e-6).alias("least"))
    cut = rows.alias("r").join(least.alias("l"), F.col(f"r.{group}").eqNullSafe(F.col(f"l.{group}"))).where(weight * F.col("r.score") >= F.col("l.least")).select("r.*")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "paper_id"], ascending=[False, True]).reset_index(drop=True)
        order = picks(g["score"].tolist(), g["route"].tolist(), g["category"].tolist(), [set(w) for w in g["words"]], k, weight)
        return pd.DataFrame({group: g[group].iloc[order].to_numpy(), "paper_id": g["paper_id"].iloc[order].to_numpy(), "place": np.arange(1, len(order) + 1, dtype=np.int32)})

    return cut.groupBy(group).applyInPandas(run, f"`{group}` {df.schema[group].dataType.simpleString()}, paper_id bigint, place int")


def _rows(d):
    return f"select year, paper_id, score, route, category, {T.stems(d, 'title')} as words from scored"


def mmr_rerank(spark, sf_dir):
    """The ten most useful papers of each year."""
    text = _rows(SPARK)
    register(spark, sf_dir, text)
    return rerank(spark.sql(text), "year")


ORACLE = f"""with recursive c as (select *, cast(row_number() over (partition by year order by score desc, paper_id) as int) as seq from ({_rows(DUCK)}) r),
sim as (select a.year, a.seq as a, b.seq as b, greatest(case when a.route <> '' and a.route = b.route then 1e0 else 0e0 end, case when a.category <> '' and a.category = b.category then 0.6e0 else 0e0 end, {T.jaccard(DUCK, "a.words", "b.words")}) as s from c a join c b on a.year = b.year),
p(year, place, seqs) as (select distinct year, 0, cast([] as int[]) from c
  union all select year, place + 1, list_append(seqs, seq) from (select p.year, p.place, p.seqs, c.seq, row_number() over (partition by p.year
      order by round(0.7e0 * c.score / 100e0 - 0.3e0 * coalesce((select max(s) from sim where sim.year = c.year and sim.a = c.seq and list_contains(p.seqs, sim.b)), 0e0), 12) desc, c.seq) as n
    from p join c on c.year = p.year and not list_contains(p.seqs, c.seq) where p.place < 10) x where n = 1),
w as (select year, place, seqs[place] as seq from p where place > 0)
select w.year, c.paper_id, cast(w.place as int) as place from w join c on c.year = w.year and c.seq = w.seq"""


__all__ = ["picks", "rerank", "mmr_rerank", "ORACLE"]
